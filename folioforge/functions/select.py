"""Which parts of a text matter: samples, keyword windows, marked-up excerpts and contexts of a given size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .detect import has, starting
from .text import first_words, fingerprint, has_text, let, lines, strip, text, without_noise

PAGE = r"(?=\[Page [0-9]+\])"
BREAK = "\n\n---\n\n"
FRONT, END = 0.22, 0.28


def pages(x: Column) -> Column:
    return F.split(x, PAGE)


def classification_sample(x: Column, page_count: int = 2, fallback_words: int = 500) -> Column:
    """The first pages with text, or the first words where pages aren't marked."""

    def of(clean: Column) -> Column:
        usable = F.when(has(clean, PAGE), F.transform(F.filter(pages(clean), has_text), strip)).otherwise(F.array().cast("array<string>"))
        return let(usable, lambda u: F.when(F.size(u) > 0, F.array_join(F.slice(u, 1, page_count), BREAK)).otherwise(first_words(clean, fallback_words)))

    return let(without_noise(x), of)


def keyword_windows(x: Column, around: int = 3) -> Column:
    """Each line with a keyword and those around it; of a single line, its pages with a keyword."""
    no_window = F.lit(None).cast("string")
    first = lambda i: F.greatest(i - around, F.lit(0))

    def of(rows: Column) -> Column:
        window = lambda s, i: F.when(has(s, fixed.KEYWORD), F.array_join(F.slice(rows, first(i) + 1, i + around + 1 - first(i)), "\n")).otherwise(no_window)
        of_pages = F.filter(F.filter(F.transform(pages(x), strip), lambda p: p != ""), lambda p: has(p, fixed.KEYWORD))
        return F.when(F.size(rows) <= 1, of_pages).otherwise(F.array_compact(F.transform(rows, window)))

    return let(F.filter(F.transform(lines(x), strip), lambda s: s != ""), of)


def joined_sections(sections: Column) -> Column:
    """Sections that aren't empty, less those that begin like an earlier one for 240 characters."""
    head = lambda s: F.left(s, F.lit(240))

    def of(tidy: Column) -> Column:
        return let(F.transform(tidy, head), lambda heads: F.array_join(F.filter(tidy, lambda s, i: F.array_position(heads, head(s)) == i + 1), BREAK))

    return let(F.filter(F.transform(sections, strip), lambda s: s != ""), of)


def relevant(x: Column, max_chars: int = 12000, around: int = 3) -> Column:
    """A text of at most ``max_chars``: whole, or its first pages and keyword windows."""

    def of(clean: Column) -> Column:
        usable = F.transform(F.filter(pages(clean), has_text), strip)
        opening = let(usable, lambda u: F.when(F.size(u) > 0, F.slice(u, 1, 2)).otherwise(F.array(F.left(clean, F.lit(4000)))))
        chosen = let(joined_sections(F.concat(opening, keyword_windows(clean, around))), lambda c: F.when(c == "", clean).otherwise(c))
        return F.when(F.length(clean) <= max_chars, clean).otherwise(F.left(chosen, F.lit(max_chars)))

    return let(without_noise(x), of)


def highlight(x: Column) -> Column:
    """Dates, amounts, months and keywords in marks; what is marked isn't marked again."""
    out = text(x)
    for name, pattern in (("DATE", starting(fixed.DATE, r"\d")), ("MONEY", starting(fixed.MONEY_MARK, r"EUG\d")), ("MONTH", starting(fixed.MONTH, "ADFJMNOS")), ("KEYWORD", fixed.KEYWORD)):
        out = F.regexp_replace(out, pattern, f"[[{name}:$0]]")
    return out


def labelled(name: str, x: Column) -> Column:
    return F.concat(F.lit(f"[{name}]\n"), strip(x))


def joined_excerpts(chunks: list[tuple[str, Column]], max_chars: int) -> Column:
    """Different chunks under their labels, one after the other, while there is room."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("seen"), F.lit(max_chars).alias("left"), F.lit(False).alias("over"))
    kind = "struct<out:array<string>,seen:array<string>,left:int,over:boolean>"
    items = F.array(*[F.struct(F.lit(name).alias("name"), strip(c).alias("chunk")) for name, c in chunks])

    def add(state: Column, item: Column) -> Column:
        mark = fingerprint(item["chunk"])
        skip = state["over"] | (item["chunk"] == "") | F.array_contains(state["seen"], mark)
        full = F.concat(F.lit("["), item["name"], F.lit("]\n"), item["chunk"])
        cut = F.when(F.length(full) > state["left"], F.regexp_replace(F.left(full, state["left"]), r"(?U)\s+$", "")).otherwise(full)
        left = state["left"] - F.length(cut) - 2
        more = F.struct(F.when(cut == "", state["out"]).otherwise(F.array_append(state["out"], cut)).alias("out"), F.array_append(state["seen"], mark).alias("seen"), F.when(cut == "", state["left"]).otherwise(left).alias("left"), ((cut == "") | (left <= 0)).alias("over")).cast(kind)
        return F.when(skip, state).otherwise(more)

    return F.aggregate(items, start.cast(kind), add, lambda s: F.array_join(s["out"], "\n\n"))


def extraction_context(x: Column, max_chars: int = 8000) -> Column:
    """A whole text under a label, or its beginning, its marked-up relevant parts and its end, in ``max_chars``."""
    if max_chars <= 0:
        return F.lit("")
    value = text(x)
    front, end = max(300, int(max_chars * FRONT)), max(300, int(max_chars * END))
    middle = highlight(relevant(value, max(500, max_chars - front - end)))
    chunks = list(zip(fixed.EXCERPTS, (F.left(value, F.lit(front)), middle, F.right(value, F.lit(end)))))
    return F.when(strip(value) == "", "").when(F.length(value) <= max_chars, labelled("FULL DOCUMENT TEXT", value)).otherwise(joined_excerpts(chunks, max_chars))


def recovery_excerpt(x: Column, max_chars: int = 6500) -> Column:
    """A text whole, or its first half, its lines with recovery keywords and its last third, in ``max_chars``."""
    value = text(x)
    half, third = max_chars // 2, -(-max_chars // 3)
    hit = lambda s: F.exists(F.array(*map(F.lit, fixed.RECOVERY_KEYWORDS)), lambda k: F.contains(F.lower(s), k))
    middle = F.left(F.array_join(F.filter(lines(value), hit), "\n"), F.lit(max(0, max_chars - half - third)))
    return F.when(F.length(value) <= max_chars, value).otherwise(F.concat(F.left(value, F.lit(half)), F.lit("\n[RELEVANT LINES]\n"), middle, F.lit("\n[DOCUMENT END]\n"), F.right(value, F.lit(third))))
