"""Filling containers of fixed capacity with texts, so that every window of containers holds the mixture of sources.

Mixture-controlled packing by deficit round-robin. Texts are spread evenly over buckets of about ``BUCKET`` rows (by hash, so that
no source crowds one). In a bucket every source is a queue, and a round is a window of ``WINDOW`` containers: each round a queue is
granted its share of the window's tokens, gives the texts that its grant covers (the last one may go over by less than half of
itself) and carries what it over- or underspent as a deficit into the next round. So up to any window's end every source is
within half a text of its share. A window's texts are packed best fit, largest first; containers left less than ``FULL`` give
their texts to the next window, each text ``WAITS`` times at most.

What a bucket hands to the next one is known beforehand, as it places all its tokens: its deficits at the end are prefix sums
of tokens per bucket and source. So buckets are packed in parallel and still carry deficits across their borders. A text above
the capacity is cut into full pieces and a rest, which pass the queues like texts. Containers still left less than ``FULL`` are
opened again and their texts packed together over all buckets in a second, much smaller round, in the same way.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewood.llm.tokens import VOCABULARY, count_tokens
from tracewood.session import Workspace

BUCKET = 50_000
WINDOW = 256  # containers
FULL = 0.98
WAITS = 3  # windows that a text may wait for a fuller container
KINDS = 1000  # the most container kinds; each is a pass over the sizes
SCHEMA = "container string, container_no long, doc_id string, piece int, token_start long, tokens long"  # ids as text: pandas would turn a column with nulls into floats


def pieces(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of each piece: only a text above the capacity is cut, into full pieces and a rest."""
    counts = np.maximum(1, -(-sizes // capacity))
    rows = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = number * capacity
    return rows, start, np.minimum(capacity, sizes[rows] - start)


def rounds(sizes: np.ndarray, queue: np.ndarray, share: np.ndarray, deficit: np.ndarray, span: int) -> np.ndarray:
    """Order of all items by the token at which their queue's deficit has grown to their middle, and the round of each.

    A queue with a share s earns s of every token served, so after t tokens it may have given s * t tokens and its deficit.
    """
    order = np.argsort(queue, kind="stable")
    ordered = sizes[order]
    before = np.cumsum(ordered) - ordered
    first = np.searchsorted(queue[order], np.arange(len(share)))
    before = before - before[np.minimum(first, len(sizes) - 1)][queue[order]]
    due = np.empty(len(sizes))
    due[order] = (before + ordered / 2 - deficit[queue[order]]) / np.maximum(share[queue[order]], 1e-300)
    last = max(0, -(-int(sizes.sum()) // span) - 1)
    return np.argsort(due, kind="stable"), np.clip(due // span, 0, last).astype(np.int64)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Container of each item and tokens of each container: largest item first, into the fullest container that has room."""
    where, used, open_ = [0] * len(sizes), [], []  # open_: (room, container), sorted
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        at = bisect_left(open_, (size, 0))
        if at < len(open_):
            room, c = open_.pop(at)
            used[c] += size
            room -= size
        else:
            c, room = len(used), capacity - size
            used.append(size)
        if room:
            insort(open_, (room, c))
        where[i] = c
    return where, used


def spread(group: np.ndarray) -> np.ndarray:
    """Order in which every stretch holds the groups about in proportion; a group's members keep theirs."""
    order = np.argsort(group, kind="stable")
    _, first, counts = np.unique(group[order], return_index=True, return_counts=True)
    place = (np.arange(len(group)) - np.repeat(first, counts) + 0.5) / np.repeat(counts, counts)
    return order[np.argsort(place, kind="stable")]


def fill(sizes: np.ndarray, queue: np.ndarray, share: np.ndarray, deficit: np.ndarray, capacity: int, window: int = WINDOW) -> np.ndarray:
    """Container number of each item (0 < size <= capacity), in rounds of ``window`` containers."""
    number = np.full(len(sizes), -1, dtype=np.int64)
    if not len(sizes):
        return number
    order, turn = rounds(sizes, queue, share, deficit, window * capacity)
    borders = np.searchsorted(turn[order], np.arange(int(turn.max()) + 2))
    held: list[int] = []
    waits = [0] * len(sizes)
    base = 0
    for w in range(len(borders) - 1):
        items = held + order[borders[w] : borders[w + 1]].tolist()
        held = []
        where, used = best_fit(sizes[items].tolist(), capacity)
        keep = [w == len(borders) - 2 or x >= FULL * capacity for x in used]
        for c, item in zip(where, items, strict=True):
            if waits[item] == WAITS:
                keep[c] = True
        # containers in the order of their items, those of one item (by queue) spread among the rest, so that parts of a window are alike
        count = np.bincount(where)
        at = np.bincount(where, weights=np.arange(len(items))) / count
        alone = np.full(len(used), -1)
        alone[where] = queue[items]
        alone[count > 1] = -1
        kept = np.flatnonzero(keep)
        kept = kept[np.argsort(at[kept], kind="stable")]
        kept = kept[spread(alone[kept])].tolist()
        place = {c: base + k for k, c in enumerate(kept)}
        base += len(kept)
        for c, item in zip(where, items, strict=True):
            if keep[c]:
                number[item] = place[c]
            else:
                held.append(item)
                waits[item] += 1
    return number


def _pack(kinds: list[tuple[str, int]]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(docs: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values(["doc_id", "n_tokens"], kind="stable").reset_index(drop=True)
        sizes = docs["n_tokens"].to_numpy()
        base = int(docs["bucket"].iloc[0]) << 32
        carries = dict(list(carry.sort_values("line", kind="stable").groupby("kind")))
        out = []
        for kind, capacity in kinds:
            lines = carries[kind]
            queues = docs["queue"].map({q: i for i, q in enumerate(lines["line"])}).to_numpy()
            rows, start, length = pieces(sizes, capacity)
            some = length > 0
            number = np.full(len(rows), -1, dtype=np.int64)
            number[some] = fill(length[some], queues[rows[some]], lines["share"].to_numpy(), lines["carry"].to_numpy(), capacity) + base
            out.append(pd.DataFrame({"container": kind, "container_no": pd.array(number, dtype="Int64"), "doc_id": docs["doc_id"].to_numpy()[rows], "piece": (start // capacity).astype("int32"), "token_start": start, "tokens": length, "queue": docs["queue"].to_numpy()[rows]}))
            out[-1].loc[~some, "container_no"] = pd.NA
        return pd.concat(out, ignore_index=True)

    return run


def _again(pdf: pd.DataFrame, carry: pd.DataFrame, capacities: dict[str, int]) -> pd.DataFrame:
    """Packs the texts of opened containers of one kind and group again."""
    kind = pdf["container"].iloc[0]
    pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
    carry = carry.sort_values("line", kind="stable").reset_index(drop=True)
    queues = pdf["queue"].map({q: i for i, q in enumerate(carry["line"])}).to_numpy()
    number = fill(pdf["tokens"].to_numpy(), queues, carry["share"].to_numpy(), carry["carry"].to_numpy(), capacities[kind])
    return pdf.assign(container_no=number + (int(pdf["again"].iloc[0]) << 32))


def carries(by: DataFrame) -> DataFrame:
    """(kind, to, line, share, carry) of (kind, step, queue, own): each queue's share of a kind's tokens, and the deficit with
    which it comes to a step, as every step places all its tokens."""
    whole = by.groupBy("kind", "queue").agg(F.sum("own").alias("q_sum"))
    total = by.groupBy("kind").agg(F.sum("own").alias("all_sum"))
    steps = by.groupBy("kind", "step").agg(F.sum("own").alias("b_sum"))
    before = Window.partitionBy("kind").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # a row per step, not per document
    steps = steps.withColumn("b_before", F.coalesce(F.sum("b_sum").over(before), F.lit(0)))
    earlier = Window.partitionBy("kind", "queue").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    told = by.withColumn("q_before", F.coalesce(F.sum("own").over(earlier), F.lit(0))).join(steps, ["kind", "step"]).join(whole, ["kind", "queue"]).join(total, "kind")
    share = F.col("q_sum") / F.greatest(F.col("all_sum"), F.lit(1))
    return told.select("kind", F.col("step").alias("to"), F.col("queue").alias("line"), share.alias("share"), (share * F.col("b_before") - F.col("q_before")).alias("carry"))


def pack(docs: DataFrame, kinds: DataFrame, vocabulary: str = VOCABULARY, bucket_rows: int = BUCKET, work: Workspace | None = None) -> DataFrame:
    """container, container_no, doc_id, piece, token_start, tokens: each text's place in each kind of container.

    A text up to the capacity lies in one container; a longer one is cut into full containers and a rest. A null or empty
    text takes no room: one row with container_no null and 0 tokens. A null source is a queue of its own. Kinds without
    name or with a capacity null or below 1 are left out, and of a repeated kind the largest capacity holds. No documents
    give no rows.
    """
    work = work or Workspace(docs.sparkSession, "packing")
    listed = kinds.filter("container is not null and capacity >= 1").groupBy("container").agg(F.max("capacity").cast("long").alias("capacity")).orderBy("container").limit(KINDS + 1).collect()
    if len(listed) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of containers")
    kind_list = [(r["container"], int(r["capacity"])) for r in listed]
    if not kind_list:
        return docs.sparkSession.createDataFrame([], SCHEMA.replace("doc_id string", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"))
    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("queue")
    sized = work.cut(count_tokens(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", queue), ["doc_id", "queue"], vocabulary=vocabulary))
    spread = F.xxhash64("doc_id", "queue", "n_tokens")
    buckets = max(1, -(-sized.count() // bucket_rows))
    sized = sized.withColumn("bucket", F.pmod(spread, F.lit(buckets)))
    steps = sized.groupBy(F.col("bucket").alias("step"), "queue").agg(F.sum("n_tokens").alias("own"))
    carry = carries(steps.withColumn("kind", F.explode(F.array(*[F.lit(k) for k, _ in kind_list]))))
    first = work.cut(sized.groupBy("bucket").cogroup(carry.groupBy("to")).applyInPandas(_pack(kind_list), f"{SCHEMA}, queue string"))
    capacities = dict(kind_list)
    caps = F.create_map(*[x for k, c in kind_list for x in (F.lit(k), F.lit(c))])
    filled = first.filter("container_no is not null").groupBy("container", "container_no").agg(F.sum("tokens").alias("used"))
    opened = work.cut(filled.filter(F.col("used") < F.lit(FULL) * F.element_at(caps, F.col("container"))).select("container", "container_no", F.lit(True).alias("opened")))
    told = first.join(opened, ["container", "container_no"], "left")
    loose = work.cut(told.filter("opened").drop("opened"))
    most = loose.groupBy("container").count().agg(F.max("count")).first()[0] or 0
    groups = max(1, -(-most // bucket_rows))
    loose = loose.withColumn("again", F.lit(buckets) + F.pmod(F.xxhash64("doc_id", "queue", "tokens"), F.lit(groups)))
    carry = carries(loose.groupBy(F.col("container").alias("kind"), F.col("again").alias("step"), "queue").agg(F.sum("tokens").alias("own")))
    packed = loose.groupBy("container", "again").cogroup(carry.groupBy("kind", "to")).applyInPandas(
        lambda pdf, carry: _again(pdf, carry, capacities)[["container", "container_no", "doc_id", "piece", "token_start", "tokens"]], SCHEMA
    )
    placed = told.filter("opened is null").select(*[c.split()[0] for c in SCHEMA.split(", ")]).unionByName(packed)
    return placed.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def fill_report(packed: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per kind: containers, tokens and the used share of their room."""
    caps = kinds.filter("container is not null and capacity >= 1").groupBy("container").agg(F.max("capacity").cast("long").alias("capacity"))
    sums = packed.groupBy("container").agg(F.count_distinct("container_no").alias("containers"), F.sum("tokens").alias("tokens"))
    return sums.join(caps, "container").select("container", "capacity", "containers", "tokens", F.round(F.col("tokens") / F.greatest(F.col("containers") * F.col("capacity"), F.lit(1)), 6).alias("used"))


def mixture_report(packed: DataFrame, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per kind and window of containers: its number, tokens, sources, total variation from the mixture of all tokens, and the
    most tokens by which a source of the window is off its share. Containers of different groups share no window."""
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    met = packed.filter("container_no is not null").join(docs.select("doc_id", source.alias("source")), "doc_id")
    by = met.groupBy("container", F.floor(F.col("container_no") / window).alias("window"), "source").agg(F.sum("tokens").alias("got"))
    whole = by.groupBy("container", "source").agg(F.sum("got").alias("q_sum"))
    total = whole.groupBy("container").agg(F.sum("q_sum").alias("all_sum"))
    share = whole.join(total, "container").select("container", "source", (F.col("q_sum") / F.col("all_sum")).alias("share"))
    size = by.groupBy("container", "window").agg(F.sum("got").alias("tokens"))
    off = by.join(size, ["container", "window"]).join(share, ["container", "source"]).withColumn("off", F.col("got") - F.col("share") * F.col("tokens"))
    # a source that is missing in a window is short of its whole share there; the surplus of the others is as large
    return off.groupBy("container", "window", "tokens").agg(F.count("*").alias("sources"), F.round(F.sum(F.greatest("off", F.lit(0.0))) / F.col("tokens"), 6).alias("distance"), F.round(F.max(F.abs("off")), 3).alias("most_off"))


__all__ = ["best_fit", "fill", "fill_report", "mixture_report", "pack", "pieces", "rounds"]
