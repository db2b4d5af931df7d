"""Translation of strptime codes and regular expressions into the dialects of Spark."""

from __future__ import annotations

import re

_CODES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "g": "SSS", "p": "a", "j": "DDD",
    "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "z": "xx", "Z": "VV", "e": "d", "-d": "d", "-m": "M", "-H": "H", "-I": "h", "-M": "m", "-S": "s", "-j": "D",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "x": "yyyy-MM-dd", "X": "HH:mm:ss", "c": "yyyy-MM-dd HH:mm:ss",
}


def java_pattern(fmt: str) -> str:
    """A Java date pattern for strptime codes."""
    out: list[str] = []
    for part in re.findall(r"%-?.|[^%]+", fmt):
        if part[0] != "%":
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", part.replace("'", "''")))
        elif part == "%%":
            out.append("%")
        elif part[1:] in _CODES:
            out.append(_CODES[part[1:]])
        else:
            raise ValueError(f"unknown format code {part}")
    return "".join(out)


def java_replacement(value: str) -> str:
    r"""``\1`` as ``$1``, with other special characters escaped."""
    return re.sub(r"\\(\d)", r"$\1", value.replace("$", r"\$"))


def quoted(text: str) -> str:
    """A regular expression that matches a text literally."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"
