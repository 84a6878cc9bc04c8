"""The saved result of a build: one small JSON file, replaced as a whole."""

from __future__ import annotations

import json
import os
import re
import tempfile
from dataclasses import dataclass, field

from ..functions.codes import MAX_LENGTH, MIN_LENGTH

NAME = ".valid-codes.json"
_CODE = re.compile(rf"[0-9A-Za-z]{{{MIN_LENGTH},{MAX_LENGTH}}}")


@dataclass
class Saved:
    """Codes, with the files and rules that they were built from."""

    files: dict[str, tuple[int, int]]
    codes: list[str]
    min_files: int = 2
    min_length: int = MIN_LENGTH
    max_length: int = MAX_LENGTH
    extra: dict = field(default_factory=dict)

    def matches(self, snapshot: dict[str, tuple[int, int]], min_files: int = 2) -> bool:
        """Whether this was built from just these files (by base name) under the rules of today."""
        if (self.min_length, self.max_length, self.min_files) != (MIN_LENGTH, MAX_LENGTH, min_files):
            return False
        return len(self.files) == len(snapshot) and all(self.files.get(os.path.basename(p)) == tuple(s) for p, s in snapshot.items())


def write_saved(folder: str, snapshot: dict[str, tuple[int, int]], codes: list[str], min_files: int = 2) -> None:
    """Write beside the target and rename, so that no reader sees half a file."""
    files = {os.path.basename(p): {"size": s, "modTime": m} for p, (s, m) in snapshot.items()}
    body = {"minLength": MIN_LENGTH, "maxLength": MAX_LENGTH, "minFiles": min_files, "files": files, "codes": codes}
    handle, temp = tempfile.mkstemp(prefix=NAME + ".", suffix=".tmp", dir=folder)
    try:
        with os.fdopen(handle, "w") as f:
            json.dump(body, f)
        os.replace(temp, os.path.join(folder, NAME))
    except BaseException:
        os.unlink(temp)
        raise


def read_saved(folder: str) -> Saved:
    """The saved result. FileNotFoundError if there is none, ValueError if it can't be trusted."""
    with open(os.path.join(folder, NAME)) as f:
        body = json.load(f)
    try:
        files = {name: (int(x["size"]), int(x["modTime"])) for name, x in (body.get("files") or {}).items()}
        codes = list(body.get("codes") or [])
        rules = int(body.get("minFiles", 0)), int(body.get("minLength", 0)), int(body.get("maxLength", 0))
    except (AttributeError, KeyError, TypeError) as e:
        raise ValueError(f"{NAME}: {e}") from e
    if not all(isinstance(c, str) and _CODE.fullmatch(c) for c in codes):
        raise ValueError(f"{NAME}: an ill-formed code")
    if any(a >= b for a, b in zip(codes, codes[1:], strict=False)):
        raise ValueError(f"{NAME}: codes are not sorted and unique")
    return Saved(files, codes, *rules)
