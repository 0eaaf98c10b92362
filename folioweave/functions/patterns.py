"""Regular expressions whose meaning is the same in Spark (Java) and in the SQL that checks it (RE2)."""

from __future__ import annotations

#: White space of Unicode text, for use inside a class; Java's own ``\\s`` is narrower.
SPACES = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
S = f"[{SPACES}]"
#: The characters of SPACES.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
DIGIT = r"\p{Nd}"

#: Java: line ends are line feeds only, and word boundaries know all letters.
LINES, WORDS, PLAIN = "(?md)", "(?Ud)", "(?d)"


def re2(pattern: str) -> str:
    """A pattern of this module as RE2 reads it."""
    for java, other in (("(?md)", "(?m)"), ("(?Umd)", "(?m)"), ("(?Ud)", ""), ("(?d)", ""), ("(?imd)", "(?im)")):
        if pattern.startswith(java):
            return other + pattern[len(java) :]
    return pattern
