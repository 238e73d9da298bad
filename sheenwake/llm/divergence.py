"""Quality rules by distribution divergence, in DataFrame functions alone (operator 1).

Every text has two histograms: over classes of characters and over the commonest words of its language
(with one bin for all other words). They are compared with the language's own histograms by the
Jensen-Shannon distance (square root of the divergence to base 2, from 0 to 1). A text too short for a
histogram to mean anything is not judged by it: the character test needs ``MIN_CHARS`` characters, the
word test ``MIN_WORDS`` words. Plain counts (short texts, repeated word windows) go first.

References are learnt from all texts: words with at least ``COMMON_SHARE`` of a language's words, the
``N_COMMON`` most frequent of them. Every language has its own, however small its share of the texts; only a
text without a language is compared with the reference of all texts. A reference of under ``REFERENCE_CHARS``
characters or ``REFERENCE_WORDS`` words is no histogram: texts are not judged by it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Java form of a run of spaces; words are what stands between.
BLANK = r"[\\x20\\x09-\\x0D]+"
#: Character classes after blanks, in the order in which they are taken out of the text.
CLASSES = {"lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "mark": "[.,;:!?()\\x22\\x27-]+",
           "symbol": "[\\x21-\\x7E]+"}
HISTOGRAM = ("blank", *CLASSES, "other")
N_COMMON = 24
COMMON_SHARE = 0.002
MIN_CHARS = 200
MIN_WORDS = 50
REFERENCE_CHARS = 2000
#: With fewer words in all, a word met once would be common.
REFERENCE_WORDS = 500
MAX_CHAR_DISTANCE = 0.32
MAX_WORD_DISTANCE = 0.37
LETTERS = [chr(c) for c in range(65, 65 + N_COMMON)]
ALL = "*"
REFERENCE = "lang string, chars array<double>, codes map<string,string>, longest int, words array<double>, n_chars bigint, n_words bigint"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeated_words() -> str:
    """Words inside 5-word windows that occur twice or more in array ``_words``.

    Windows are compared by 64-bit hashes, made from those of words, pairs and fours. Texts without a repeated window stop at the first test; in the
    others equal neighbours of the sorted windows give the repeated positions, whose cover is summed.
    """
    def joined(left, at, right, shift, less):
        n = f"size(_words) - {less}"
        return f"zip_with(slice({left}, {at}, {n}), slice({right}, {shift}, {n}), (x, y) -> xxhash64(x, y))"

    grams = _let("h", "transform(_words, w -> xxhash64(w))", _let("p", joined("h", 1, "h", 2, 1), _let(
        "q", joined("p", 1, "p", 3, 3), joined("q", 1, "h", 5, 4))))
    pairs = "array_sort(transform(g, (h, i) -> named_struct('h', h, 'i', i)))"
    again = ("array_sort(transform(filter(s, (x, j) -> (j > 0 and s[greatest(j - 1, 0)].h = x.h) or "
             "(j < size(s) - 1 and s[least(j + 1, size(s) - 1)].h = x.h)), x -> x.i))")
    cover = ("aggregate(d, named_struct('n', 0, 'at', -5), (a, i) -> "
             "named_struct('n', a.n + least(5, i - a.at), 'at', i), a -> a.n)")
    found = _let("s", pairs, _let("d", again, cover))
    counted = _let("g", grams, f"if(size(array_distinct(g)) = size(g), 0, {found})")
    return f"if(size(_words) < 6, 0, {counted})"


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_words`` and the plain counts of each text; a null text counts as empty."""
    t = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    t = (t.withColumn("_words", _words("_text"))
         .withColumn("_solid", F.array_join("_words", ""))
         .withColumn("_lines", F.expr("filter(split(_text, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')")))
    t = t.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length("_solid").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": F.expr(_repeated_words()).cast("bigint")})
    t, sizes = _class_sizes(t, "_solid")
    blank = F.length("_text") - F.length("_solid")
    return (t.withColumn("_chars", F.array(*[s.cast("double") for s in (blank, *sizes)]))
            # counted where letters, digits and marks are out of the way already
            .withColumn("n_symbols", F.expr("length(_rest3) - length(regexp_replace(_rest3, '[#*$%&|<>]+', ''))").cast("bigint"))
            .drop("_solid", "_lines", *[f"_rest{n}" for n in range(len(CLASSES))]))


def _words(text: str) -> Column:
    return F.expr(f"array_remove(split({text}, '{BLANK}', -1), '')")


def _class_sizes(t: DataFrame, solid: str) -> tuple[DataFrame, list[Column]]:
    """``t`` with what each class leaves of ``solid``, and the number of characters of each class and of others."""
    rest, sizes = solid, []
    for n, pattern in enumerate(CLASSES.values()):
        t = t.withColumn(f"_rest{n}", F.regexp_replace(rest, pattern, ""))
        sizes.append(F.length(rest) - F.length(f"_rest{n}"))
        rest = f"_rest{n}"
    return t, [*sizes, F.length(rest)]


def _language(lang_col: str) -> Column:
    """The language whose reference a row takes, ``*`` where it names none."""
    return F.when(F.col(lang_col) != "", F.col(lang_col)).otherwise(F.lit(ALL))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per language, and one (``*``) for all texts: lang, chars, codes (word to letter), longest, words, n_chars, n_words.

    chars and words are histograms that sum to 1, n_chars and n_words what they were made from. Words are counted
    by language; a language's row holds its ``N_COMMON`` commonest at most. An empty table gives no rows.
    """
    t = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), _language(lang_col).alias("lang"))
    counts = cut_lineage(t.select("lang", F.explode(_words("text")).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("k")))
    # Characters are classed in distinct words, each for all its places; what texts hold beside words is blank.
    words, classes = _class_sizes(counts, "w")
    sums = [F.sum(F.col("k") * size).alias(f"c{i}") for i, size in enumerate(classes, 1)]
    solid = words.groupBy("lang").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.length("w")).alias("solid"), *sums)
    whole = t.groupBy("lang").agg(F.sum(F.length("text")).alias("length"))
    none = lambda c: F.coalesce(c, F.lit(0))
    sizes = cut_lineage(whole.join(solid, "lang", "left").select(
        "lang", (F.col("length") - none("solid")).cast("double").alias("c0"),
        *[none(f"c{i}").cast("double").alias(f"c{i}") for i in range(1, len(HISTOGRAM))], none("n").alias("n")))
    # rows without a language count for all texts alone
    own = F.col("lang") != ALL
    total = [F.sum(c).alias(c) for c in sizes.columns[1:]]
    sizes = cut_lineage(sizes.where(own).unionByName(
        sizes.groupBy().agg(F.lit(ALL).alias("lang"), *total).where("n is not null")))
    small = sizes.select("lang", F.greatest(F.lit(1.0), COMMON_SHARE * F.col("n")).alias("least"))
    all_words = counts.groupBy("w").agg(F.sum("k").alias("k")).select(F.lit(ALL).alias("lang"), "w", "k")
    common = counts.where(own).unionByName(all_words).join(small, "lang").where("k >= least")
    place = Window.partitionBy("lang").orderBy(F.desc("k"), "w")
    top = (common.withColumn("at", F.row_number().over(place)).where(F.col("at") <= N_COMMON)
           .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "w", "k"))).alias("top")))
    r = sizes.join(top, "lang", "left").withColumn("top", F.coalesce("top", F.expr(
        "cast(array() as array<struct<at: int, w: string, k: bigint>>)")))
    solid = F.expr(" + ".join(c for c in sizes.columns if c[0] == "c"))
    share = f"concat(transform(top, x -> x.k / n), array_repeat(0D, {N_COMMON} - size(top)))"
    letters = ", ".join(f"'{c}'" for c in LETTERS)
    return cut_lineage(r.select(
        "lang", F.array(*[F.col(f"c{k}") / F.greatest(solid, F.lit(1.0)) for k in range(len(HISTOGRAM))]).alias("chars"),
        F.expr(f"map_from_arrays(transform(top, x -> x.w), slice(array({letters}), 1, size(top)))").alias("codes"),
        F.expr("coalesce(array_max(transform(top, x -> octet_length(x.w))), 0)").alias("longest"),
        F.expr(f"concat(if(n > 0, {share}, array_repeat(0D, {N_COMMON})), "
               "array(1D - aggregate(top, 0D, (s, x) -> s + x.k / n)))").alias("words"),
        solid.cast("bigint").alias("n_chars"), F.col("n").alias("n_words")))


def js_distance(p: str, q: str) -> str:
    """SQL of the Jensen-Shannon distance of two histograms that sum to 1."""
    part = "if({0} > 0, {0} * log2({0} / (({0} + {1}) / 2)), 0D)"
    each = f"zip_with({p}, {q}, (a, b) -> {part.format('a', 'b')} + {part.format('b', 'a')})"
    return f"sqrt(greatest(0D, aggregate({each}, 0D, (s, x) -> s + x) / 2))"


def apply_rules(docs: DataFrame, reference: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with counts, both distances and the verdicts.

    A distance is null where the text is below its minimum length, or the language has no reference or one of
    too little text; it then fails nothing.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance,
    base_failed, kept. Columns of these names are replaced. Rows stay as they are, repeated ones too; a null
    or empty text fails as too short; a row without a language takes the reference of all texts.
    """
    own = reference.select(*[F.col(c).alias(f"_ref_{c}") for c in reference.columns])
    t = measure(docs, text_col).withColumn("_key", _language(lang_col)).join(own, F.col("_key") == F.col("_ref_lang"), "left")
    size = "aggregate(_chars, 0D, (s, x) -> s + x)"
    coded = ("array_join(transform(_words, w -> if(octet_length(w) > _ref_longest, '', coalesce(_ref_codes[w], ''))), '')")
    t = t.withColumn("_coded", F.when(
        (F.col("n_words") >= MIN_WORDS) & (F.col("_ref_n_words") >= REFERENCE_WORDS), F.expr(coded)))
    n = F.col("n_words").cast("double")
    t = t.withColumn("_hits", F.array(*[(F.length("_coded") - F.length(F.replace(F.col("_coded"), F.lit(c), F.lit("")))) / n
                                        for c in LETTERS], (n - F.length("_coded")) / n))
    t = t.withColumn("char_distance", F.expr(
        f"if({size} >= {MIN_CHARS} and _ref_n_chars >= {REFERENCE_CHARS}, {js_distance(f'transform(_chars, x -> x / {size})', '_ref_chars')}, null)"))
    t = t.withColumn("word_distance", F.when(F.col("_coded").isNotNull(), F.expr(js_distance("_hits", "_ref_words"))))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    near = ((F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE)
            & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE))
    t = t.withColumn("base_failed", failed).withColumn("kept", ~failed & near)
    return t.drop("_text", "_words", "_chars", "_key", "_coded", "_hits", *[f"_ref_{c}" for c in reference.columns])
