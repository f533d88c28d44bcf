"""Problem 8: mixing sources to target weights.

Hierarchical budgeting over a tree of domain, language and source. A leaf's weight is its source's target share, split
by language in proportion to its tokens; weights add up to the root. The budget flows down: a node's share is divided
among its children by weight, none gets more than it can fill with all its uses, and what a child cannot take goes to
its siblings; only what all siblings together cannot take was already given to the ancestor's other children. Each
leaf then takes whole epochs and a token-prefix of a last, seeded one.

The prefix is found without sorting a leaf in one place: tokens are summed by slices of the seeded order, the slice
in which the budget ends is found from those sums, and only that slice is sorted.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulegrid.runtime import checkpointed, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICES = 1 << 14
SEED = 17

#: Which domain a source belongs to; sources not named here form their own.
DOMAINS = {
    "circular": "rules", "guidance": "rules", "faq": "rules", "training_note": "rules",
    "inspection_note": "proceedings", "minutes": "proceedings", "ombudsman_award": "proceedings", "staff_memo": "proceedings",
    "complaint": "public", "press_release": "public", "bulletin": "public",
}


def source_label(text: Column) -> Column:
    """One label whatever the case, blanks and separators."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")


def language_label(text: Column) -> Column:
    """The language without a region, 'und' where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim(text)), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit("")), F.lit("und"))


def _counter(path: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pdf.drop(columns="text").assign(tokens=np.array(sizes, "i8"))

    return count


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, lang, tokens), one row per doc_id; of differing rows of one doc_id the greatest counts."""
    rows = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(source_label(F.col("source")), F.lit("")).alias("source"), language_label(F.col("lang")).alias("lang"), "text")
    counted = spread(rows, "doc_id").mapInPandas(_counter(tokenizer), "doc_id long, source string, lang string, tokens long")
    return counted.groupBy("doc_id").agg(F.max(F.struct("tokens", "source", "lang")).alias("r")).select("doc_id", "r.source", "r.lang", "r.tokens")


def pour(amount: float, weights: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Divides the amount by weight, none above its room; what one cannot take goes to the others by their weights."""
    given, open_ = np.zeros(len(weights)), (room > 0) & (weights > 0)
    while amount > 1e-9 and open_.any():
        part = np.where(open_, weights, 0) / weights[open_].sum() * amount
        taken = np.minimum(part, room - given)
        given += taken
        amount -= taken.sum()
        full = open_ & (room - given <= 1e-9)
        if not full.any():
            break
        open_ &= ~full
    return given


def budget(leaves: pd.DataFrame, amount: float, levels: list[str]) -> np.ndarray:
    """Each leaf's tokens: `leaves` has the levels, weight and room."""
    if not levels:
        return np.array([min(amount, leaves["room"].sum())])
    out = np.zeros(len(leaves))
    groups = [(at, leaves.iloc[at]) for _, at in sorted(leaves.groupby(levels[0], dropna=False).indices.items())]
    shares = pour(amount, np.array([g["weight"].sum() for _, g in groups]), np.array([g["room"].sum() for _, g in groups]))
    for (at, group), share in zip(groups, shares):
        out[at] = budget(group, share, levels[1:])
    return out


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["domain", "lang", "source"], ignore_index=True)
    pdf["given"] = budget(pdf, float(pdf["total"].iloc[0]), ["domain", "lang", "source"])
    pdf["budget"] = np.floor(pdf["given"] + 0.5).astype("i8")
    return pdf[["domain", "lang", "source", "tokens", "weight", "budget", "given"]]


def _targets(targets: DataFrame) -> DataFrame:
    return targets.groupBy(source_label(F.col("source")).alias("source")).agg(F.min("source").alias("label"), F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source IS NOT NULL")


def source_totals(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, label, target_share, max_repeats, tokens, total) of every target; total is that of all documents."""
    sums = counts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    return _targets(targets).join(sums, "source", "left").join(F.broadcast(total)).withColumn("tokens", F.coalesce("tokens", F.lit(0)))


def leaf_budgets(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(domain, lang, source, tokens, weight, budget, given) of every leaf of the tree of targets; `given` is not rounded.

    A target without documents is a leaf of no room: its weight stays in its domain, and its siblings take its share.
    """
    domain = F.create_map(*[F.lit(x) for pair in DOMAINS.items() for x in pair])
    totals = source_totals(counts, targets)
    sums = counts.groupBy("source", "lang").agg(F.sum("tokens").alias("leaf_tokens")).where("leaf_tokens > 0")
    leaves = totals.join(sums, "source", "left").withColumns({"leaf_tokens": F.coalesce("leaf_tokens", F.lit(0)), "lang": F.coalesce("lang", F.lit("und"))})
    ready = leaves.select(
        F.coalesce(F.try_element_at(domain, F.col("source")), F.col("source")).alias("domain"), "lang", "source", F.col("leaf_tokens").alias("tokens"),
        (F.col("target_share") * F.coalesce(F.try_divide("leaf_tokens", "tokens"), F.lit(1.0))).alias("weight"),
        (F.col("leaf_tokens") * F.col("max_repeats")).cast("double").alias("room"), "total",
    )
    # One row per leaf of the tree: as many as there are pairs of a targeted source and a language.
    return ready.groupBy().applyInPandas(_plan, "domain string, lang string, source string, tokens long, weight double, budget long, given double")


def selection(counts: DataFrame, leaves: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, lang, tokens, uses): the documents of the mix and how often each is used."""
    plan = leaves.where("tokens > 0").select("source", "lang", (F.col("budget") / F.col("tokens")).cast("int").alias("epochs"), (F.col("budget") % F.col("tokens")).alias("rest"))
    # The plan is a few rows, one per leaf; the planner broadcasts it by its size.
    order = F.xxhash64(F.lit(seed), "epochs", "doc_id")
    rows = counts.where("tokens > 0").join(plan, ["source", "lang"]).withColumn("order", order).withColumn("slice", F.pmod(F.shiftrightunsigned("order", 40), F.lit(SLICES)).cast("int"))
    sums = rows.groupBy("source", "lang", "slice").agg(F.sum("tokens").alias("slice_tokens"))
    along = Window.partitionBy("source", "lang").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("slice_tokens").over(along), F.lit(0)))
    placed = rows.join(starts, ["source", "lang", "slice"])
    whole = placed.where("before + slice_tokens <= rest").withColumn("extra", F.lit(1))
    none = placed.where("before >= rest").withColumn("extra", F.lit(0))
    within = Window.partitionBy("source", "lang").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.where("before < rest AND before + slice_tokens > rest").withColumn("extra", (F.sum("tokens").over(within) + F.col("before") <= F.col("rest")).cast("int"))
    uses = whole.unionByName(none).unionByName(edge)
    return uses.select("doc_id", "source", "lang", "tokens", (F.col("epochs") + F.col("extra")).alias("uses")).where("uses > 0")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(selection, shares) of a mix as large as all documents together.

    documents: doc_id, source, lang, text; targets: source, target_share, max_repeats (the most uses of a document).
    selection: doc_id, source, lang, tokens, uses. shares: source, target_share, actual_share, tokens_used, is_short,
    is_short meaning that the source's budget, which is at least its target unless all its uses are given, is below it. Source labels match whatever the case,
    blanks and separators; documents of other sources, or of none, count for the size of the mix only. Null and empty
    texts have no tokens and are not selected, repeated rows count once, a target without documents is short and has
    no share. The last document of a prefix is left out where it would exceed the budget, so shares stay below by less
    than one document a leaf. Empty tables give an empty selection and, with targets, all of them short.
    """
    counts = checkpointed(token_counts(documents, tokenizer))
    leaves = checkpointed(leaf_budgets(counts, targets))
    chosen = selection(counts, leaves, seed)
    given = leaves.groupBy("source").agg(F.sum("given").alias("given"))
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used"))
    size = used.agg(F.sum("tokens_used").alias("mix_tokens"))
    shares = source_totals(counts, targets).join(used, "source", "left").join(given, "source", "left").join(F.broadcast(size))
    return chosen, shares.select(
        F.col("label").alias("source"), "target_share", F.round(F.coalesce(F.col("tokens_used") / F.col("mix_tokens"), F.lit(0.0)), 6).alias("actual_share"),
        F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), _short().alias("is_short"),
    )


def _short() -> Column:
    """Below the target by more than the rounding of sums."""
    return F.coalesce("given", F.lit(0.0)) < F.col("target_share") * F.col("total") - F.lit(1e-6)


def short_sources(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source): the sources whose budget stays below their target share even when used as often as allowed."""
    counts = checkpointed(token_counts(documents, tokenizer))
    given = leaf_budgets(counts, targets).groupBy("source").agg(F.sum("given").alias("given"))
    return source_totals(counts, targets).join(given, "source", "left").where(_short()).select(F.col("label").alias("source"))
