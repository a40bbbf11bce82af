"""Quality rules by distribution divergence (native).

Base rules count words, symbols, repeated lines and repeated 5-word windows of
each text. The divergence rule compares two histograms of a document with the
references of its language by Jensen-Shannon distance (base 2, so 0 to 1):

- character classes (lower, upper, digit, white space, sentence marks, other
  ASCII, beyond ASCII);
- the language's ``COMMON`` most frequent words and one bin for all others.

References are sums over all documents of the language that pass the base
rules; the common words are counted over all documents. Guards: below
``MIN_CHARS`` characters or ``MIN_WORDS`` words a histogram says too little and
is not judged; nor is a document whose language is null or has less than
``MIN_REFERENCE`` words in all.

Everything per document is a column expression inside the scan's stage; the
shuffles carry (language, word) counts and one histogram per document.

Repeated windows are compared by 64-bit hashes within one text (two different
windows of the same text agree with a probability below 1e-10).

Defined results: a null text is an empty one (0 words, fails the base rules);
equal texts of one language have equal results; repeated rows stay repeated;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabprep.llm.common import SPACE_GAP, small_or_shuffled, words
from tabprep.session import materialize

COMMON = 20
#: Common words of all languages up to which they are one literal set.
SET_WORDS = 2000
MIN_CHARS = 200
MIN_WORDS = 100
MIN_REFERENCE = 1000
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.45
REPEAT = 5

#: Character classes in the order in which they are taken out of the text.
CLASSES = [("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("space", r"[\x20\x09-\x0D]+"), ("digit", "[0-9]+"),
           ("mark", r"""[.,;:!?'"()-]+"""), ("ascii", r"[\x00-\x7F]+")]
SYMBOLS = "[#*$%&|<>]"

#: Words covered by 5-word windows whose hash occurs twice or more.
_REPEATED = f"""aggregate(sort_array(transform(filter(grams,
      (g, j) -> g.h <=> get(grams, j - 1).h or g.h <=> get(grams, j + 1).h), g -> g.i)),
    named_struct('n', 0L, 'end', 0),
    (a, i) -> named_struct('n', a.n + (i + {REPEAT} - greatest(a.end, i)), 'end', i + {REPEAT}), a -> a.n)"""


def common_words(docs: DataFrame, lang: str = "lang", text: str = "text", top: int = COMMON) -> DataFrame:
    """``lang, common``: the most frequent words of each language over all
    documents, by count, then word."""
    counts = (docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(
        words(text, SPACE_GAP)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")))
    by_rank = W.partitionBy("lang").orderBy(F.desc("n"), "word")
    # row_number() <= top is a group limit: each task keeps its own top rows before the shuffle by language
    best = counts.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= top)
    return best.groupBy("lang").agg(F.sum("n").alias("n_common"), F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda r: r["word"]).alias("common"))


def measure(docs: DataFrame, common: DataFrame, n_langs: int, doc_id: str = "doc_id", text: str = "text",
            lang: str = "lang") -> DataFrame:
    """Base counts and both histograms of every document row."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.join(small_or_shuffled(common.select("lang", "common"), n_langs), "lang", "left")
    d = d.withColumn("w", words("text", SPACE_GAP)).withColumn("rest0", F.col("text"))
    for k, (name, pattern) in enumerate(CLASSES):
        d = d.withColumn(f"rest{k + 1}", F.regexp_replace(f"rest{k}", pattern, ""))
    lengths = [F.char_length(f"rest{k}") for k in range(len(CLASSES) + 1)]
    classes = F.array(*[a - b for a, b in zip(lengths, lengths[1:])], lengths[-1])
    after_marks = f"rest{[n for n, _ in CLASSES].index('mark') + 1}"
    hashes = F.when(F.size("w") >= REPEAT, F.expr(
        f"transform(slice(w, 1, size(w) - {REPEAT - 1}), (x, i) -> xxhash64(x, "
        + ", ".join(f"w[i + {j}]" for j in range(1, REPEAT)) + "))"))
    if n_langs * COMMON <= SET_WORDS:  # one hash look-up per word among the common words of all languages
        every = [r[0] for r in common.select(F.explode("common")).distinct().collect()]
        is_common = lambda x: x.isin(every)
    else:
        is_common = lambda x: F.array_contains(F.col("common"), x)
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("doc_id", "lang", "common", "w", classes.alias("classes"),
                 (F.char_length("text") - (lengths[2] - lengths[3])).cast("long").alias("word_chars"),
                 F.regexp_count(after_marks, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                 lines.alias("lines"), hashes.alias("hashes"),
                 F.filter("w", is_common).alias("cw"))
    grams = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform(
        "hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("grams", grams)
    hits = F.transform("common", lambda c: F.size("cw") - F.size(F.array_remove("cw", c)))
    d = d.withColumn("hits", hits)
    other = F.size("w") - F.aggregate("hits", F.lit(0), lambda n, x: n + x)
    d = d.select("doc_id", "lang", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols",
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.coalesce(F.expr(_REPEATED), F.lit(0)).cast("long").alias("n_repeat_words"), "classes",
                 F.concat("hits", F.array(other)).alias("word_bins"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def references(measured: DataFrame, top: int = COMMON, min_reference: int = MIN_REFERENCE) -> DataFrame:
    """``lang, class_ref, word_ref``: summed histograms of the documents that
    pass the base rules, for languages with enough words."""
    ok = measured.filter(~F.col("base_failed") & F.col("word_bins").isNotNull())
    bins = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(i)).cast("double")) for i in range(n)])
    return (ok.groupBy("lang").agg(F.sum("n_words").alias("n"), bins("classes", len(CLASSES) + 1).alias("class_ref"),
                                   bins("word_bins", top + 1).alias("word_ref"))
            .filter(F.col("n") >= min_reference).drop("n"))


def js_distance(a: str, b: str) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms; null if one is empty.
    Missing bins count as empty."""
    def norm(c: str) -> Column:
        filled = F.transform(c, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
        total = F.aggregate(filled, F.lit(0.0), lambda s, x: s + x)
        return F.when(total > 0, F.transform(filled, lambda x: x / total))

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    terms = F.zip_with(norm(a), norm(b), lambda p, q: part(F.coalesce(p, F.lit(0.0)), F.coalesce(q, F.lit(0.0)))
                       + part(F.coalesce(q, F.lit(0.0)), F.coalesce(p, F.lit(0.0))))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", top: int = COMMON,
          min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, min_reference: int = MIN_REFERENCE,
          max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """One row per document row: base counts, ``class_distance`` and
    ``word_distance`` (null where a guard holds), ``base_failed``, ``kept``."""
    common = materialize(common_words(docs, lang, text, top), "common-words")
    n_langs = common.count()
    measured = materialize(measure(docs, common, n_langs, doc_id, text, lang), "quality")
    d = measured.join(small_or_shuffled(references(measured, top, min_reference), n_langs), "lang", "left")
    long_text = F.aggregate("classes", F.lit(0), lambda s, x: s + x) >= min_chars
    d = d.withColumns({
        "class_distance": F.when(long_text & F.col("class_ref").isNotNull(), js_distance("classes", "class_ref")),
        "word_distance": F.when((F.col("n_words") >= min_words) & F.col("word_ref").isNotNull(),
                                js_distance("word_bins", "word_ref"))})
    far = (F.coalesce(F.col("class_distance") > max_class, F.lit(False))
           | F.coalesce(F.col("word_distance") > max_word, F.lit(False)))
    return d.withColumn("kept", ~F.col("base_failed") & ~far).drop(
        "classes", "word_bins", "class_ref", "word_ref")
