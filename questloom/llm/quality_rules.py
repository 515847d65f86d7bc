"""Quality rules whose cutoffs carry a guarantee.

Each rule compares one ratio of a text with a cutoff.  A cutoff is only used in a stratum (by default a language)
if labelled documents prove that it seldom rejects good ones: of ``n`` good labelled documents of the stratum it
rejects ``k``, and the exact binomial (Clopper-Pearson) upper bound of the rejection rate is at most the risk that
the rule may take.  All tests that are made, over strata, rules and candidate cutoffs, share one error
probability (Bonferroni), and the rules of a stratum share one risk, so that with probability 1 - ``delta`` no
stratum loses more than ``alpha`` of its good documents to the chosen cutoffs.  The candidates are fixed beforehand
and nothing is fitted, so every labelled document is a holdout.

Among the cutoffs that are proven safe, a rule takes the mildest of those that reject the most labelled bad documents;
a rule without proof or without use is off in that stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questloom.llm.common import keep_rows, let, whole_text, words
from questloom.session import stage

#: Largest share of a stratum's good documents that all chosen cutoffs together may reject.
ALPHA = 0.05
#: Probability that the guarantee fails anywhere.
DELTA = 0.05

#: rule: (ratio, +1 if large values are rejected or -1 if small ones are, candidate cutoffs from mild to strict)
RULES = {
    "symbols": ("n_symbols / n_words", 1, [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "dup_lines": ("n_dup_lines / n_lines", 1, [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "repeats": ("n_repeat_words / n_words", 1, [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "long_words": ("word_chars / n_words", 1, [40.0, 30.0, 25.0, 20.0, 15.0, 12.0, 10.0]),
    "short_words": ("word_chars / n_words", -1, [1.0, 1.5, 2.0, 2.5, 3.0]),
    "few_words": ("n_words", -1, [55.0, 60.0, 70.0, 80.0]),
}


def repeated_words(tokens: Column) -> Column:
    """How many words stand in a window of three words that the text holds twice or more.

    The windows are ordered by hash, then by their words, then by place, so that equal ones are neighbours; the
    places of those that have an equal neighbour are put in order, and each counts the words up to the next one.
    Texts whose windows all have different hashes are done without this.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - 3), lambda i: F.xxhash64(tokens[i], tokens[i + 1], tokens[i + 2])
    )

    def suspects(hashed: Column) -> Column:
        # Places whose hash (44 bits of it) occurs elsewhere too; of longer texts, all places.
        packed = F.transform(hashed, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 20), 20).bitwiseOR(i.cast("long")))

        def beside(p: Column) -> Column:
            last = F.size(p) - 1
            same = lambda x, y: F.shiftright(x.bitwiseXOR(y), 20) == 0
            near = F.filter(
                p,
                lambda x, j: (
                    ((j > 0) & same(x, p[F.greatest(j - 1, F.lit(0))])) | ((j < last) & same(x, p[F.least(j + 1, last)]))
                ),
            )
            return F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << 20) - 1)).cast("int"))

        return F.when(F.size(hashed) < 1 << 20, let(F.sort_array(packed), beside)).otherwise(
            F.sequence(F.lit(0), F.size(hashed) - 1)
        )

    def exact(hashed: Column) -> Column:
        windows = F.transform(
            suspects(hashed),
            lambda i: F.struct(
                F.xxhash64(tokens[i], tokens[i + 1], tokens[i + 2]).alias("h"),
                F.struct(tokens[i], tokens[i + 1], tokens[i + 2]).alias("w"),
                i.alias("i"),
            ),
        )

        def places(s: Column) -> Column:
            last = F.size(s) - 1
            same = F.filter(
                s,
                lambda x, j: (
                    ((j > 0) & (x["w"] == s[F.greatest(j - 1, F.lit(0))]["w"]))
                    | ((j < last) & (x["w"] == s[F.least(j + 1, last)]["w"]))
                ),
            )
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        def covered(at: Column) -> Column:
            following = F.slice(at, F.lit(2), F.size(at))
            steps = F.zip_with(at, following, lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

        return let(F.sort_array(windows), lambda s: let(places(s), covered))

    return F.when(F.size(tokens) < 3, F.lit(0).cast("long")).otherwise(
        let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(exact(h)),
        )
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the columns of ``keep``, and n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words.

    Null and empty texts have 0 everywhere.  Lines are parted by line feeds; only those with a word count.
    """
    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        *[c.alias(name) for name, c in (keep or {}).items()],
        whole_text(text_col).alias("text"),
    )

    def lines(column: str) -> Column:
        return F.filter(F.split(column, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    found = texts.select(
        *[c for c in texts.columns if c != "text"],
        let(
            words(F.col("text")),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(w).alias("n_repeat_words"),
            ),
        ).alias("m"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(
            lines("text"),
            lambda a: F.struct(
                F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines")
            ),
        ).alias("l"),
    )
    return found.select(
        *[c for c in found.columns if c not in ("m", "l", "n_symbols")],
        "m.n_words",
        "m.word_chars",
        "n_symbols",
        "l.n_dup_lines",
        "l.n_lines",
        "m.n_repeat_words",
    )


def base_failed() -> Column:
    """The fixed rules: under fifty words, or over half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(rule: str) -> Column:
    """The rule's ratio; null where the text has nothing to divide by, and then the rule lets it pass."""
    top, _, bottom = RULES[rule][0].partition(" / ")
    value = F.col(top).cast("double")
    return F.try_divide(value, F.col(bottom).cast("double")) if bottom else value


def beyond(rule: str, cutoff: Column) -> Column:
    over = ratio(rule) > cutoff if RULES[rule][1] > 0 else ratio(rule) < cutoff
    return F.coalesce(over, F.lit(False))


def allowed_errors(n: Column, risk: float, error: Column) -> Column:
    """The largest k for which P(X <= k) is at most ``error`` when X is binomial (n, risk); -1 if none is.

    With at most so many false rejections, the exact upper bound of their rate at level 1 - ``error`` is at most
    ``risk``.  The terms are summed in logarithms; k is below n * risk, as half of the weight lies there.
    """
    step = math.log(risk) - math.log1p(-risk)
    start = F.struct(
        (n * math.log1p(-risk)).cast("double").alias("term"), F.lit(None).cast("double").alias("sum"), F.lit(-1).cast("long").alias("k")
    )

    def add(state: Column, i: Column) -> Column:
        total = F.when(state["sum"].isNull(), state["term"]).otherwise(
            F.greatest(state["sum"], state["term"]) + F.log1p(F.exp(-F.abs(state["sum"] - state["term"])))
        )
        return F.struct(
            (state["term"] + F.log((n - i + F.lit(1e-9)) / (i + 1)) + step).alias("term"),
            total.alias("sum"),
            F.when(total <= F.log(error), i).otherwise(state["k"]).alias("k"),
        )

    tries = F.sequence(F.lit(0).cast("long"), F.floor(n * risk).cast("long"))
    return F.aggregate(tries, start, add, lambda state: state["k"])


def cutoffs(measured: DataFrame, labels: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA, rules=None) -> DataFrame:
    """One row per stratum with labelled documents: stratum, n_good, and the chosen cutoff of each rule (null: off).

    ``measured`` has stratum and the columns of ``measures``; ``labels`` has doc_id and quality (1 good, 0 bad, others
    and nulls are not used).  The documents that count are those that the fixed rules let pass.
    """
    rules = list(rules or RULES)
    truth = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seen = measured.where(~base_failed()).join(truth, "doc_id")
    tries = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(float(c)).alias("cutoff"), beyond(r, F.lit(float(c))).alias("hit"))
            for r in rules
            for i, c in enumerate(RULES[r][2])
        ]
    )
    n_tries = sum(len(RULES[r][2]) for r in rules)
    counted = (
        seen.select("stratum", "quality", F.explode(tries).alias("t"))
        .groupBy("stratum", "t.rule", "t.i", "t.cutoff")
        .agg(
            F.count_if(F.col("quality") == 1).alias("n_good"),
            F.count_if((F.col("quality") == 1) & F.col("t.hit")).alias("good_hit"),
            F.count_if((F.col("quality") == 0) & F.col("t.hit")).alias("bad_hit"),
        )
    )
    counted = stage(counted, "rule-counts")
    sizes = counted.groupBy("stratum").agg(F.max("n_good").alias("n_good"))
    n_strata = max(1, sizes.count())
    limit = sizes.withColumn("k", allowed_errors(F.col("n_good"), alpha / len(rules), F.lit(delta / (n_tries * n_strata))))
    limit = limit.select(F.col("stratum").alias("of"), F.col("k"))
    safe = counted.join(limit, F.col("stratum").eqNullSafe(F.col("of"))).where("good_hit <= k AND bad_hit > 0")
    mildest = safe.groupBy("stratum", "rule").agg(F.min_by("cutoff", F.struct(-F.col("bad_hit"), F.col("i"))).alias("cutoff"))
    chosen = mildest.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in rules])
    return chosen


#: Up to so many strata, their table of cutoffs is sent to the tasks; beyond, it is joined.
SMALL = 10_000


def judge(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text",
          alpha: float = ALPHA, delta: float = DELTA, keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, stratum, the measures, base_failed, kept and broken (names of broken rules).

    ``kept`` is false if ``base_failed`` is, or if a rule that is on in the document's stratum rejects it.  Null or
    empty texts have no words and fail.  Nulls in ``stratum`` are a stratum of their own; a stratum without labelled
    documents has no rules on, and without any labels only the fixed rules act.  Rows repeated whole are judged
    alike.  Labels of unknown documents are not used; of several labels of a document the lowest counts.
    ``keep`` names further columns to carry along.
    """
    extra = {**(keep or {}), "stratum": F.col(stratum)}
    measured = stage(measures(docs, id_col, text_col, extra), "measures")
    chosen = stage(cutoffs(measured, labels, alpha=alpha, delta=delta), "cutoffs").withColumnRenamed("stratum", "of")
    side = F.broadcast(chosen) if chosen.count() <= SMALL else chosen
    joined = measured.join(side, F.col("stratum").eqNullSafe(F.col("of")), "left")
    broken = F.array_compact(F.array(*[F.when(beyond(r, F.col(f"cut_{r}")), F.lit(r)) for r in RULES]))
    return joined.select(
        "doc_id",
        *(keep or {}),
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & (F.size(broken) == 0)).alias("kept"),
        F.array_join(broken, ",").alias("broken"),
    )


def good_documents(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns and in no order."""
    mark = F.xxhash64(whole_text(text_col))
    kept = judge(docs, labels, stratum=stratum, id_col=id_col, text_col=text_col, keep={"mark": mark}).where("kept")
    on = {"doc_id": F.col(id_col), "stratum": F.col(stratum), "mark": mark}
    return keep_rows(docs, kept.select(*on), on)
