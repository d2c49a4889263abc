"""Compatibility decomposition (NFKD) without combining marks, as native column expressions.

The tables are made from Python's Unicode data. Characters that become one character, and marks, which go, are one translation. Those that become
several are rare: only texts that hold such a one are taken apart, and each character is looked up in two steps, its block and then
the block's own small map. Hangul syllables are computed. Order within a decomposition never matters, since the marks that might change places are dropped."""
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points in a block; marks that part entries and their sides in a block's text, which no decomposition holds.
BLOCK, ENTRY, SIDE = 128, "\ue000", "\ue001"
HANGUL = (0xAC00, 0xD7A3)


@cache
def _tables() -> tuple[str, str, dict[int, dict[str, str]]]:
    """Characters to translate and what they become (marks, which go, last), and blocks of characters that become several."""
    singles, marks, several = [], [], {}
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000 or HANGUL[0] <= code <= HANGUL[1]:
            continue
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain == c:
            continue
        if not plain:
            marks.append(c)
        elif len(plain) == 1:
            singles.append((c, plain))
        else:
            several.setdefault(code // BLOCK, {})[c] = plain
    return "".join(c for c, _ in singles) + "".join(marks), "".join(p for _, p in singles), several


def _ranges(codes) -> str:
    """A character class of code points, as ranges."""
    out, codes = [], sorted(codes)
    start = last = codes[0]
    for code in [*codes[1:], None]:
        if code != last + 1 if code is not None else True:
            out.append(f"\\x{{{start:x}}}-\\x{{{last:x}}}")
            start = code
        last = code
    return "[" + "".join(out) + "]"


@cache
def _wide() -> str:
    """A pattern of the characters that become several, Hangul syllables too."""
    return _ranges([ord(c) for block in _tables()[2].values() for c in block] + list(range(HANGUL[0], HANGUL[1] + 1)))


def plain_letters(x: Column) -> Column:
    """NFKD of a text without combining marks; null for null."""
    singles, become, several = _tables()
    blocks = sorted(several)
    maps = F.array(*[F.str_to_map(F.lit(ENTRY.join(c + SIDE + p for c, p in several[b].items())), F.lit(ENTRY), F.lit(SIDE)) for b in blocks])
    place = F.str_to_map(F.lit(ENTRY.join(f"{b}{SIDE}{i + 1}" for i, b in enumerate(blocks))), F.lit(ENTRY), F.lit(SIDE))
    lead, vowel, tail = ("".join(map(chr, range(first, first + n))) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))

    def one(c: Column) -> Column:
        code = F.ascii(c)
        s = code - HANGUL[0]
        jamo = F.concat(F.substr(F.lit(lead), F.floor(s / 588).cast("int") + 1, F.lit(1)), F.substr(F.lit(vowel), F.floor(s % 588 / 28).cast("int") + 1, F.lit(1)), F.when(s % 28 > 0, F.substr(F.lit(tail), s % 28, F.lit(1))).otherwise(""))
        own = F.try_element_at(F.try_element_at(maps, F.try_element_at(place, F.floor(code / BLOCK).cast("string")).cast("int")), c)
        return F.when(code.between(*HANGUL), jamo).otherwise(F.coalesce(own, c))

    short = F.translate(x, singles, become)
    return F.when(x.rlike(r"^[\x00-\x7f]*$"), x).when(short.rlike(_wide()), F.array_join(F.transform(F.split(short, ""), one), "")).otherwise(short)
