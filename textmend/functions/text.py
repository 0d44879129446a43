"""Tokens, segments, sentences and fact tokens as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value), with value computed once; in a lambda Spark would compute it again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


# Java's \W and \s know ASCII only; the classes below are Unicode's.
EDGE = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$"
ALNUM_EDGE = r"^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$"
INNER = r"[^0-9A-Za-z\u00C0-\u024F]+"
DIGIT = r"[\p{Nd}\u00B2\u00B3\u00B9\u2070-\u2079]"
#: A character that every fact token holds; small letters are passed over first.
IN_FACTS = r"[[^a-z\n]&&[\p{Lu}£" + DIGIT[1:-1] + "]]"

# The words and marks that the rules of the reference data name.
TITLES = ["Mr.", "Mrs.", "Messrs.", "Dr.", "Wm.", "Thos.", "Capt.", "Rev.", "Col."]
NOT_FACTS = ["mr", "mrs", "dr", "st", "the", "miss", "sir", "rev", "messrs"]
AMOUNT_END = r"[\d½¼¾][sdl]\.[)”’\"]*$"
LEADING_DASH = r"^(?:[–—]|-{2,})+(?U:\s)*"
STRIPPED = ".,;:!?\"'“”‘’()[]—–-"
QUOTES, PLAIN_QUOTES = "’‘“”–—", "''\"\"--"


def words(text: Column) -> Column:
    """Tokens parted by Unicode white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def normalize(raw: Column) -> Column:
    """Paragraphs of a raw text: a hyphen at a line's end joins, an empty line parts, white space is one space."""
    text = F.regexp_replace(F.regexp_replace(raw, "\u00a0", " "), r"(?<=[A-Za-z])-\n(?=[a-z])", "-")
    return F.filter(F.transform(F.split(text, r"\n(?U:\s)*\n"), lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " "))), lambda p: p != "")


def lines(raw: Column) -> Column:
    """Paragraphs of a text whose lines are paragraphs."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " "))), lambda p: p != "")


def segments(paragraph: Column) -> Column:
    """A plain segmenter: a segment ends at . ! or ? with closing marks before white space."""
    return F.split(F.regexp_replace(paragraph, r"([.!?][)\]”’\"']*) +", "$1\n"), "\n")


def rejoined(parts: Column) -> Column:
    """Sentences of a paragraph's segments. False splits are undone: after a title or an initial, before a lower-case start,
    between two parts of an amount. A dash at the start goes.

    Whether a segment starts a sentence depends on itself and the segment before alone, so all is decided at once."""
    full = F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " "))), lambda s: s != "")

    def joins(s: Column, before: Column) -> Column:
        last = F.substring_index(before, " ", -1)
        bare = F.regexp_replace(last, r"^[^\p{L}\p{N}_]+", "")
        lower = s.rlike(r"^[^\p{L}\p{N}_]*\p{Ll}")
        amount = s.rlike(r"^[\d½¼¾]") & last.rlike(AMOUNT_END)
        return lower | amount | bare.isin(*TITLES) | bare.rlike(r"^[A-Z]\.$")

    # zip_with reads each array once; a lambda that names another array would make it anew for every element
    def piece(s: Column, before: Column) -> Column:
        return F.when(s.isNull(), "").when(before.isNull(), s).when(joins(s, before), F.concat(F.lit(" "), s)).otherwise(F.concat(F.lit("\n"), s))

    marked = let(full, lambda f: F.zip_with(f, F.concat(F.array(F.lit(None).cast("string")), f), piece))
    whole = F.split(F.array_join(marked, ""), "\n")
    return F.filter(F.transform(whole, lambda s: F.regexp_replace(s, LEADING_DASH, "")), lambda s: s != "")


def sentences(paragraphs: Column, segment=segments) -> Column:
    """All sentences of a document in order. segment: column to array of segments."""
    return F.flatten(F.transform(paragraphs, lambda p: rejoined(segment(p))))


def band(n: Column, bands: list[tuple[int, int]]) -> Column:
    """Name of the closed interval that holds n, or null."""
    out = F.lit(None).cast("string")
    for lo, hi in bands:
        out = F.when(n.between(lo, hi), F.lit(f"{lo}-{hi}")).otherwise(out)
    return out


def is_fact(token: Column, before: Column) -> Column:
    """A token with a digit or a pound sign, or a capitalised one that isn't first (before is null), listed, or after a colon."""
    core = F.lower(F.regexp_replace(token, EDGE, ""))  # made only for the capitalised, of which I alone becomes i
    name = before.isNotNull() & token.rlike(r"^[^\p{L}\p{N}_]*\p{Lu}") & ~F.coalesce(before, F.lit("")).endswith(":") & ~core.isin("i", *NOT_FACTS)
    return token.rlike(DIGIT) | token.contains("£") | name


def fact_positions(tokens: Column) -> Column:
    """Places of the fact tokens. One pass over the joined tokens (which hold no line break) marks those with a character that
    every fact has; only these are judged."""

    def places(w: Column) -> Column:
        marked = F.split(F.regexp_replace(F.array_join(w, "\n", ""), IN_FACTS, "\u0001"), "\n")
        maybe = F.filter(F.transform(marked, lambda t, i: F.when(F.contains(t, F.lit("\u0001")), i)), lambda i: i.isNotNull())
        return F.filter(maybe, lambda i: F.coalesce(is_fact(F.get(w, i), F.get(w, i - 1)), F.lit(False)))

    return let(tokens, places)


def mark_words(tokens: Column, idx: Column, left: str = "[", right: str = "]") -> Column:
    return F.array_join(F.transform(tokens, lambda t, i: F.when(F.array_contains(idx, i), F.concat(F.lit(left), t, F.lit(right))).otherwise(t)), " ")


def edge_parts(word: Column) -> tuple[Column, Column, Column]:
    """What is before the first letter or digit, what is between, what is after the last. All is before if there is none."""
    w = F.coalesce(word, F.lit(""))
    return F.regexp_extract(w, ALNUM_EDGE, 1), F.regexp_extract(w, ALNUM_EDGE, 2), F.regexp_extract(w, ALNUM_EDGE, 3)


def slot_core(word: Column) -> Column:
    """What is compared: the core, or the whole word if it's marks only."""
    w = F.trim(word)
    core = edge_parts(w)[1]
    return F.when(core != "", core).otherwise(w)


def word_core(token: Column) -> Column:
    """Typographic marks made plain, then outer marks stripped; tokens are taken to be in composed form."""
    return F.regexp_replace(F.translate(token, QUOTES, PLAIN_QUOTES), EDGE, "")


def parts_of(core: Column) -> Column:
    """Runs of letters and digits, or the whole if there is none."""
    found = F.filter(F.split(core, INNER), lambda p: p != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(core))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty words."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def length_flag(gold: Column, other: Column, gap: int = 3) -> Column:
    d = F.char_length(other) - F.char_length(gold)
    return F.when(d >= gap, "merged").when(d <= -gap, "split")


def block_type(gold: Column, other: Column) -> Column:
    return F.when((F.char_length(gold) > 2) | (F.char_length(other) > 2), "other").when((gold != "") & (other != ""), "substitution").when(gold != "", "deletion").otherwise("insertion")


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of part."""
    return ((F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))) / F.char_length(part)).cast("long")


def bracketed(text: Column, k: Column) -> Column:
    """The answers in braces, in order; null if there aren't k."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\{(.*?)\}"), 1), lambda w: F.trim(w))
    return F.when(F.size(found) == k, found)


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def hits(text: Column, pattern: str) -> Column:
    """How often a pattern occurs."""
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def separators(core: Column) -> Column:
    """What lies between the parts of a core, in order."""
    return F.regexp_extract_all(core, F.lit(f"(?<=[0-9A-Za-zÀ-ɏ])({INNER})(?=[0-9A-Za-zÀ-ɏ])"), 1)


def multiword(answers: Column) -> Column:
    """Positions of answers with a space inside."""
    spaced = F.transform(answers, lambda w, i: F.when(F.instr(F.trim(w), " ") > 0, i))
    return F.filter(spaced, lambda i: i.isNotNull())
