"""What scanning confuses, in one place: pairs of letters read as one, and letters of one look. Fixed values."""

from __future__ import annotations

PAIRS = (("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("ri", "n"))
LOOKS = str.maketrans({"c": "e", "f": "t", "1": "l", "i": "l", "!": "l", "0": "o", "5": "s", "6": "b", "h": "b", "y": "v", "9": "g", "@": "a"})
#: Digits in words, read as letters.
DIGITS = str.maketrans({"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "6": "b", "8": "b", "9": "g"})
