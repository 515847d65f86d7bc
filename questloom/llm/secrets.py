"""Secret scans over every version of every file, each content scanned once per rule version.

A version's content is addressed by its SHA-256.  The ledger holds, for each address, which rule versions have
scanned it and what they found, as places and never as text.  A scan reads the versions, keeps one copy of each content
that lacks a scan by some current rule version, runs only those rules on it, and adds the outcome to the ledger;
findings are then joined back to every path and version with that content.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questloom.llm.common import let, whole_text
from questloom.session import stage


class Rule(NamedTuple):
    """A kind of secret: what it looks like, what of a match must hold, and the version of this definition.

    ``group`` and ``least`` drop matches whose group (0: the whole) is shorter than ``least`` characters; the text of a
    dropped match is not searched again.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed: the first three kinds.  A shorter run of hex digits or of capitals after AKIA can't hold a longer match, so
#: their least length is part of the pattern.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("forge_token", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})"),
    Rule("chat_token", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", 1, r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: The columns of a ledger, e.g. for an empty one.
LEDGER = "address string, rules array<string>, spans array<struct<kind:string,start:int,end:int>>"


_MATCH = "array<struct<rule:int,place:int,gap:int,width:int,held:int>>"


def matches(text: Column, rule: Rule, number: int) -> Column:
    """The leftmost matches that don't overlap, each with the characters between it and the one before, its own, and its group's.

    Splitting the text at the matches gives what lies between them; ``spans_of`` adds the lengths up.
    """
    pattern = F.lit(rule.pattern)

    def found_of(found: Column) -> Column:
        held = found if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
        pairs = F.arrays_zip(
            F.transform(F.slice(F.split(text, rule.pattern, -1), 1, F.size(found)), lambda x: F.char_length(x)).alias("gap"),
            F.transform(found, lambda x: F.char_length(x)).alias("width"),
            F.transform(held, lambda x: F.char_length(x)).alias("held"),
        )
        return F.transform(
            pairs,
            lambda x, i: F.struct(F.lit(number).alias("rule"), i.alias("place"), x["gap"].alias("gap"), x["width"].alias("width"), x["held"].alias("held")),
        )

    none = F.array().cast(_MATCH)
    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(found_of(found)))


def spans_of(scanned: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(address, rules, spans) from (address, rules, matches): places by running sums over the matches of an address and rule.

    A match is a row here, so that the work is in proportion to their number, however many one text has.
    """
    each = scanned.select("address", "rules", F.explode_outer("matches").alias("x")).select("address", "rules", "x.*")
    upto = Window.partitionBy("address", "rule").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(upto).cast("int"))
    least = F.array(*[F.lit(r.least) for r in rules])
    kind = F.array(*[F.lit(r.kind) for r in rules])
    span = F.struct(F.get(kind, F.col("rule")).alias("kind"), (F.col("end") - F.col("width")).alias("start"), F.col("end").alias("end"))
    kept = F.collect_list(F.when(F.col("held") >= F.get(least, F.col("rule")), span))
    return placed.groupBy("address").agg(F.first("rules").alias("rules"), kept.alias("spans"))


def address(text: Column) -> Column:
    return F.sha2(text, 256)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, *, text_col: str = "text") -> DataFrame:
    """What the ledger lacks: (address, rules, spans) for each content that some rule version has not scanned yet.

    ``rules`` of a row names the rule versions that were run now; a content without findings has a row too, so that it
    is not scanned again.  Null texts count as empty.  ``ledger`` (of such rows, several per address allowed) may be
    None.  Append the result to the ledger to make it complete.
    """
    texts = versions.select(whole_text(text_col).alias("text")).withColumn("address", address(F.col("text")))
    if ledger is None:
        todo = texts.groupBy("address", "text").agg(F.lit(None).cast("array<string>").alias("done"))
    else:
        done = ledger.select("address", F.explode_outer("rules").alias("rule")).groupBy("address").agg(F.collect_set("rule").alias("done"))
        complete = done.where(F.size(F.array_except(F.array(*[F.lit(r.key) for r in rules]), "done")) == 0)
        unseen = texts.join(complete.select("address"), "address", "left_anti")
        todo = unseen.groupBy("address", "text").count().drop("count").join(done, "address", "left")
    pending = {r.key: ~F.coalesce(F.array_contains("done", r.key), F.lit(False)) for r in rules}
    found = [matches(F.col("text"), r, i) for i, r in enumerate(rules)]
    if ledger is None:
        # What ran is the same everywhere, so it need not be carried along.
        scanned = todo.select("address", F.lit(None).cast("array<string>").alias("rules"), F.concat(*found).alias("matches"))
        return spans_of(scanned, rules).withColumn("rules", F.array(*[F.lit(r.key) for r in rules]))
    ran = F.array_compact(F.array(*[F.when(pending[r.key], F.lit(r.key)) for r in rules]))
    found = [F.when(pending[r.key], x).otherwise(F.array().cast(_MATCH)) for r, x in zip(rules, found)]
    return spans_of(todo.select("address", ran.alias("rules"), F.concat(*found).alias("matches")), rules)


def findings(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, *, key_cols: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Every row of ``versions`` by its keys, with its address and the spans of the current rules, by start and kind.

    ``ledger`` must be complete for these contents.  Findings of kinds that are no longer among the rules are left out.
    Rows repeated are returned each time.
    """
    keys = [F.col(c) for c in key_cols]
    paths = versions.select(*keys, address(whole_text(text_col)).alias("blob::address"))
    order = {r.kind: i for i, r in enumerate(rules)}
    kinds = F.array(*[F.lit(k) for k in order])
    several = ledger.select("address", "spans").select(
        "address", F.filter("spans", lambda x: F.array_contains(kinds, x["kind"])).alias("spans")
    )
    ranks = F.create_map(*[F.lit(v) for pair in order.items() for v in pair])
    keyed = F.transform(
        F.col("spans"), lambda x: F.struct(x["start"].alias("start"), ranks[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))
    )
    # One row for each scan of an address, of which there are as many as there were rule versions.
    one = several.groupBy("address").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    # A scan entered twice gives each span twice, side by side once sorted.
    once = let(F.array_sort(keyed), lambda all_: F.filter(all_, lambda x, i: (i == 0) | (x != F.get(all_, i - 1))))
    one = one.select(F.col("address").alias("blob::address"), once.alias("spans"))
    return paths.join(one, "blob::address").select(
        *[F.col(c) for c in key_cols], F.col("blob::address").alias("address"), "spans"
    )


def scan_all(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, *, key_cols: Sequence[str] = ("doc_id",), text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The findings of all rows of ``versions``, and the new rows of the ledger, scanned and stored once."""
    new = stage(scan(versions, ledger, rules, text_col=text_col), "secret-ledger")
    whole = new if ledger is None else ledger.select("address", "rules", "spans").unionByName(new)
    return findings(versions, whole, rules, key_cols=key_cols, text_col=text_col), new


def digest_text(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
