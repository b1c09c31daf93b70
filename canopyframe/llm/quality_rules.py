"""Operator 5: quality rules with a distribution-divergence test, in DataFrame functions only.

Base rules look at one text: too few words, or too many words inside repeated three-word windows.
The divergence rule compares a text's histogram of character classes, and its histogram of the
commonest words of its language, with that language's reference (the sums over all documents that
pass the base rules) by the Jensen-Shannon distance, the square root of the divergence in bits,
between 0 and 1. A histogram is judged only if the text is long enough for it; a text whose
language has no word list or no reference is not judged.

Defined results: a NULL or empty text has no words and fails the base rule. NULL ``lang`` is never
judged by divergence. Rows are independent, so ties and repeated rows get equal verdicts. Empty
tables give empty results. Other columns are ignored by ``features`` and kept by ``accepted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.text import SPACE_CHARS, fresh
from canopyframe.session import cut

# Very common words of the languages in use.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los"),
}
# Order of the character classes: lower-case a-z, A-Z, digits, punctuation, symbols, other letters and signs, white space.
CLASSES = 7
MIN_WORDS = 50
MIN_CHARS_FOR_CLASSES = 200
MIN_WORDS_FOR_COMMON = 100
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.22

_REPEATS = """
coalesce(element_at(transform(array(sort_array(transform(_win, (x, i) -> named_struct('h', x, 'i', i)))), a ->
  element_at(transform(array(sort_array(transform(filter(a, (e, j) ->
        coalesce(get(a, j - 1).h = e.h, false) or coalesce(get(a, j + 1).h = e.h, false)), e -> e.i))), p ->
    aggregate(transform(p, (v, j) -> least(3, coalesce(get(p, j + 1) - v, 3))), 0L, (s, v) -> s + v)), 1)), 1), 0L)"""


def features(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: base counts and the two histograms, and the ``carried`` columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*carried, "doc_id", "lang", text.alias("_text"), F.btrim(text, F.lit(SPACE_CHARS)).alias("_trim"))
    common = F.element_at(F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("lang"))
    base = base.select(
        *carried, "doc_id", "lang", "_text",
        F.expr(r"if(_trim = '', cast(array() as array<string>), split(_trim, '[\\x20\\x09-\\x0D]+'))").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        # All that is neither a-z nor white space; the classes below only look at this.
        F.regexp_replace("_text", r"[a-z\x20\x09-\x0D]+", "").alias("_rest"),
        common.alias("_common"),
    )
    base = base.select(
        *carried, "doc_id", "lang", "_text", "_rest", "_common", "_words",
        F.size("_words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.char_length("_rest") - F.char_length(F.regexp_replace("_rest", r"[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr("""slice(transform(_words, (w, i) -> xxhash64(w, get(_words, i + 1), get(_words, i + 2))),
                        1, greatest(size(_words) - 2, 0))""").alias("_win"),
        F.filter("_words", lambda w: F.array_contains(F.col("_common"), F.lower(w))).alias("_hits"),
    )
    upper, digits, punct = (
        (F.char_length("_rest") - F.char_length(F.regexp_replace("_rest", c, ""))).cast("bigint")
        for c in ("[A-Z]+", "[0-9]+", r"[!\"'()+,\-./:;=?@\[\\\]^_`{}~]+"))
    out = base.select(
        *carried, "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.expr(f"CASE WHEN size(array_distinct(_win)) = size(_win) THEN 0L ELSE {_REPEATS} END").alias("n_repeat_words"),
        F.char_length("_text").cast("bigint").alias("_chars"), F.char_length("_rest").cast("bigint").alias("_nrest"),
        upper.alias("_upper"), digits.alias("_digits"), punct.alias("_punct"),
        F.expr("transform(_common, c -> cast(size(filter(_hits, h -> lower(h) = c)) as bigint))").alias("_hist"),
    )
    space = F.col("_chars") - F.col("word_chars")
    classes = F.array(
        F.col("_chars") - space - F.col("_nrest"), F.col("_upper"), F.col("_digits"), F.col("_punct"), F.col("n_symbols"),
        F.col("_nrest") - F.col("_upper") - F.col("_digits") - F.col("_punct") - F.col("n_symbols"), space)
    return out.select(
        *carried, "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        classes.alias("classes"),
        # The common words' counts, then all other words'.
        F.expr("concat(_hist, array(n_words - aggregate(_hist, 0L, (s, v) -> s + v)))").alias("common"),
    )


def references(feats: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_common): summed histograms of the listed languages' sound documents."""
    n_words = len(next(iter(COMMON_WORDS.values()))) + 1
    cell = lambda c, i: F.sum(F.get(c, F.lit(i)))
    return (
        feats.filter(F.col("lang").isin(*COMMON_WORDS) & ~F.col("base_failed")).groupBy("lang")
        .agg(F.array(*[cell("classes", i) for i in range(CLASSES)]).alias("ref_classes"),
             F.array(*[cell("common", i) for i in range(n_words)]).alias("ref_common"))
    )


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two count arrays; NULL if either is missing or sums to zero."""
    total = lambda c: f"aggregate({c}, 0L, (s, v) -> s + v)"
    part = "CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0D END"
    return F.expr(
        f"sqrt(greatest(0D, 0.5D * aggregate(zip_with(transform({p}, v -> v / {total(p)}), transform({q}, v -> v / {total(q)}), "
        f"(x, y) -> {part.format(x='x', y='y')} + {part.format(x='y', y='x')}), 0D, (s, v) -> s + v)))")


def judged(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Features with both distances and ``kept``, and the ``carried`` columns."""
    feats = cut(features(docs, carried))
    # One row per listed language at most.
    both = feats.join(F.broadcast(references(feats)), "lang", "left")
    sums = both.withColumn("_c", F.expr("aggregate(classes, 0L, (s, v) -> s + v)"))
    dist = sums.select(
        *carried, "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("_c") >= MIN_CHARS_FOR_CLASSES, distance("classes", "ref_classes")).alias("class_distance"),
        F.when(F.col("n_words") >= MIN_WORDS_FOR_COMMON, distance("common", "ref_common")).alias("word_distance"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return dist.withColumn("kept", ~F.col("base_failed") & near)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, each by its own verdict whatever its ``doc_id``."""
    whole = fresh(docs, "_qr_row")
    rows = docs.withColumn(whole, F.struct(*docs.columns))
    return judged(rows, (whole,)).filter("kept").select(f"{whole}.*")
