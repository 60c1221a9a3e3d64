"""Text normalisation as native Column functions; nulls are empty texts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

#: Line ends as Unicode knows them, and those that aren't LF.
LINE_END, ODD_END = r"\R|[\x1c-\x1e]", r"[\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"
#: White space as Unicode knows it, and runs of it that aren't one space already.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
RUNS = r"(?U)[\s&&[^ ]]\s*| \s+"
#: Those of them that are no controls and end no line.
SPACES = "".join(c for c in WHITE if unicodedata.category(c) == "Zs")


def col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: ColumnOrName) -> Column:
    return F.coalesce(col(x).cast("string"), F.lit(""))


def let(x: Column, use) -> Column:
    """``use`` of a value that is worked out once, for values that ``use`` needs more than once."""
    return F.get(F.transform(F.array(x), lambda v: use(v)), F.lit(0))


def strip(x: ColumnOrName) -> Column:
    """Without white space (Unicode's) at either end."""
    return F.btrim(text(x), F.lit(WHITE))


def strip_of(x: ColumnOrName, chars: str) -> Column:
    """Without the given characters at either end."""
    own = "".join("\\" + c for c in chars)
    return F.regexp_replace(text(x), f"^[{own}]+|[{own}]+$", "")


def collapse(x: ColumnOrName) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text(x), RUNS, " "))


def lines(x: ColumnOrName) -> Column:
    return F.when(F.regexp_like(text(x), F.lit(ODD_END)), F.split(text(x), LINE_END)).otherwise(F.split(text(x), "\n"))


def _unmarked(code: int) -> str:
    """What is left of a character's compatibility decomposition without its combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))


def _ranges(chars: list[str]) -> str:
    """The inside of a character class, neighbours as ranges."""
    runs: list[list[int]] = []
    for code in map(ord, chars):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(rf"\x{{{a:x}}}" + (rf"-\x{{{b:x}}}" if b > a else "") for a, b in runs)


#: Hangul syllables, which fall apart by arithmetic: first and last, vowels and finals of each lead.
_SYLLABLES, _VOWELS, _FINALS = (0xAC00, 0xD7A3), 21, 28
#: Beyond it no character has a decomposition.
_DECOMPOSED = 0x30000
_CHANGED = {
    chr(code): _unmarked(code) for code in range(0x80, _DECOMPOSED)
    if not 0xD800 <= code <= 0xDFFF and not _SYLLABLES[0] <= code <= _SYLLABLES[1] and (unicodedata.decomposition(chr(code)) or unicodedata.combining(chr(code)))
}
#: Characters that become one other, those that go, and those that become several.
_ONE = {c: to for c, to in _CHANGED.items() if len(to) == 1 and to != c}
_GONE = [c for c, to in _CHANGED.items() if to == ""]
_SEVERAL = {c: to for c, to in _CHANGED.items() if len(to) > 1}
_APART = f"[{_ranges(list(_SEVERAL))}{_ranges([chr(c) for c in range(_SYLLABLES[0], _SYLLABLES[1] + 1)])}]"
#: What is not Latin letters, common signs and quotes that become one character or stay: a short class, as most texts have no more.
_UNCOMMON = f"[^{_ranges([chr(c) for c in [*range(0x250), *range(0x2010, 0x2020), 0x20AC] if chr(c) not in _SEVERAL])}]"


def _falls_apart(piece: Column) -> Column:
    """A piece whose first character, if it becomes several, is in its parts: by its place in a table or, for Hangul, by arithmetic."""
    c = F.left(piece, F.lit(1))
    table = lambda values: F.split(F.lit("\n".join(values)), "\n")
    jamo = lambda start, n: table([chr(start + i) for i in range(n)])
    number = F.ascii(c) - F.lit(_SYLLABLES[0])
    lead = F.get(jamo(0x1100, 19), (number / (_VOWELS * _FINALS)).cast("int"))
    vowel = F.get(jamo(0x1161, _VOWELS), (number % (_VOWELS * _FINALS) / _FINALS).cast("int"))
    final = F.get(F.split(F.lit("\n" + "\n".join(chr(0x11A8 + i) for i in range(_FINALS - 1))), "\n"), (number % _FINALS).cast("int"))
    place = F.instr(F.lit("".join(_SEVERAL)), c)
    parts = F.when((c >= chr(_SYLLABLES[0])) & (c <= chr(_SYLLABLES[1])), F.concat(lead, vowel, final)).when((c != "") & (place > 0), F.get(table(list(_SEVERAL.values())), place - 1)).otherwise(c)
    return F.concat(parts, F.substr(piece, F.lit(2)))


def without_marks(x: ColumnOrName) -> Column:
    """The compatibility decomposition (NFKD) without combining marks, for all of Unicode.

    As marks go, their order doesn't matter, so each character stands for itself: ASCII texts stay as they are, others
    are translated, and only texts with characters that become several are taken apart at these.
    """
    def plain(whole: Column) -> Column:
        pieces = F.split(whole, f"(?={_APART})")
        apart = F.when(F.regexp_like(whole, F.lit(_UNCOMMON)), F.array_join(F.transform(pieces, _falls_apart), "")).otherwise(whole)
        return F.translate(apart, "".join(_ONE) + "".join(_GONE), "".join(_ONE.values()))

    return F.when(F.length(text(x)) == F.octet_length(text(x)), text(x)).otherwise(plain(text(x)))


def folded(x: ColumnOrName) -> Column:
    """Lower-cased without marks, dotless i as i: whatever a (?iU) pattern takes for an ASCII letter, or for it with a mark, is that letter here."""
    return F.translate(without_marks(F.lower(text(x))), "ı", "i")


def label(x: ColumnOrName) -> Column:
    """For comparing labels: trimmed, lower-cased, without marks, single spaces."""
    return F.regexp_replace(without_marks(F.lower(strip(x))), RUNS, " ")


def comparable(x: ColumnOrName) -> Column:
    """For comparing values: without marks, upper-cased, single spaces."""
    return collapse(F.upper(without_marks(x)))


def alphanumeric(x: ColumnOrName) -> Column:
    """The letters and digits of ``comparable``, whose white space needs no folding as it goes."""
    return F.regexp_replace(F.upper(without_marks(x)), "[^A-Z0-9]+", "")


def account(x: ColumnOrName) -> Column:
    return F.upper(F.regexp_replace(text(x), r"(?U)[\s.-]", ""))


def document(x: ColumnOrName) -> Column:
    """A document's text: LF line ends, no NUL, single spaces, no empty blocks."""
    plain = F.replace(F.regexp_replace(text(x), "\r\n?", "\n"), F.lit("\x00"), F.lit(""))
    joined = F.array_join(F.transform(lines(plain), collapse), "\n")
    blocks = F.filter(F.transform(F.split(joined, "\n\n"), strip), lambda b: b != "")
    return strip(F.array_join(blocks, "\n\n"))


def by_line(x: ColumnOrName) -> Column:
    """Every LF line, blank ones too, with tabs, form feeds, CRs and spaces as one space and no space of Unicode's (Zs) at its ends."""
    return F.array_join(F.transform(F.split(text(x), "\n"), lambda s: F.btrim(F.regexp_replace(s, "[\t\f\r][\t\f\r ]*| [\t\f\r ]+", " "), F.lit(SPACES))), "\n")


def searchable(x: ColumnOrName) -> Column:
    """What detectors look at: LF line ends, plain spaces, no runs of spaces."""
    ends = lambda t: F.when(F.contains(t, F.lit("\r")), F.regexp_replace(t, "\r\n?", "\n")).otherwise(t)
    plain = lambda t: F.when(F.length(t) == F.octet_length(t), t).otherwise(F.regexp_replace(t, "[\xa0\u2007\u202f]", " "))
    return let(let(let(text(x), ends), plain), lambda t: F.when(F.contains(t, F.lit("\t")) | F.contains(t, F.lit("  ")), F.regexp_replace(t, "[ \t]+", " ")).otherwise(t))


def letters_and_digits(x: ColumnOrName) -> Column:
    return F.length(F.regexp_replace(text(x), r"[^\p{L}\p{N}]", ""))


def without_noise(x: ColumnOrName) -> Column:
    """Collapsed lines, less empty ones and long ones of which under 35 % are letters or digits."""
    kept = F.filter(
        F.transform(lines(F.replace(text(x), F.lit("\x00"), F.lit(" "))), collapse),
        lambda s: (s != "") & ~((F.length(s) > 20) & (letters_and_digits(s) / F.length(s) < 0.35)),
    )
    return F.array_join(kept, "\n")


def distinct(values: Column) -> Column:
    """Trimmed, not empty, each once, in order."""
    return F.array_distinct(F.filter(F.transform(values, strip), lambda v: v != ""))


def sorted_distinct(values: Column) -> Column:
    return F.array_sort(distinct(values))


def words(x: ColumnOrName) -> Column:
    return F.filter(F.split(text(x), r"(?U)\s+"), lambda w: w != "")


def first_words(x: ColumnOrName, n: int) -> Column:
    return F.array_join(F.slice(words(x), 1, n), " ")


def has_text(x: ColumnOrName) -> Column:
    return F.regexp_like(text(x), F.lit(r"(?:[\p{L}\p{N}][^\p{L}\p{N}]*+){20}"))


def fingerprint(x: ColumnOrName) -> Column:
    return F.sha2(collapse(F.lower(text(x))), 256)


def notes(*parts: ColumnOrName) -> Column:
    """Trimmed parts that aren't empty, with bars between."""
    return F.array_join(F.filter(F.array(*[strip(p) for p in parts]), lambda p: p != ""), " | ")


def whole_number(x: ColumnOrName) -> Column:
    return F.coalesce(F.when(strip(x) != "", strip(x)).try_cast("int"), F.lit(0))


def first_of(values: Column) -> Column:
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def first_match(x: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or empty."""
    return F.regexp_extract(x, pattern, group)


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))
