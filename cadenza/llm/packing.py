"""Filling fixed-capacity containers (problem 6): variable-capacity best-fit decreasing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.session import cut


def best_fit(sizes: np.ndarray, lengths: Sequence[int], overhead: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, final length of each bin) for sizes in falling order, none above max(lengths).

    An item goes into the open bin that it fills best. Where none has room, a bin is opened at the permitted length of
    least cost: its overhead and the space that would stay unused, per token that it would hold. What could still be put in is known
    exactly: the sums that items to come can make (a bit set for each suffix of the items), as far as their tokens
    aren't promised to bins opened before. At the end each bin shrinks to the least permitted length that holds its contents.
    """
    lengths = sorted(lengths)
    whole = (1 << (lengths[-1] + 1)) - 1
    sums = [1] * (len(sizes) + 1)  # bit f of sums[i]: some of the items from i on have f tokens together
    for i in range(len(sizes) - 1, -1, -1):
        sums[i] = sums[i + 1] | (sums[i + 1] << int(sizes[i])) & whole
    rest, promised = int(sizes.sum()), 0
    open_: dict[int, list[int]] = {}
    mask = 0  # bit f: some bin has f tokens free
    where, used, owed = np.empty(len(sizes), np.int64), [], []
    for i, s in enumerate(map(int, sizes)):
        rest -= s
        if m := mask >> s:
            free = s + (m & -m).bit_length() - 1
            b = open_[free].pop()
            if not open_[free]:
                mask &= ~(1 << free)
            kept = max(owed[b] - s, 0)
            promised += kept - owed[b]
            owed[b] = kept
        else:
            best = None
            for n in lengths:
                if n >= s:
                    fill = min((sums[i + 1] & ((1 << (n - s + 1)) - 1)).bit_length() - 1, max(rest - promised, 0))
                    cost = (overhead + n - s - fill) / max(s + fill, 1)
                    if best is None or cost < best[0]:
                        best = cost, n, fill
            _, free, fill = best
            b = len(used)
            used.append(0)
            owed.append(fill)
            promised += fill
        used[b] += s
        free -= s
        open_.setdefault(free, []).append(b)
        mask |= 1 << free
        where[i] = b
    final = np.asarray(lengths)[np.searchsorted(lengths, np.asarray(used, np.int64))] if used else np.empty(0, np.int64)
    return where, final


def pack(items: DataFrame, id_col: str, size: Column, capacity: int = 1024, lengths: Sequence[int] = (128, 256, 512, 1024), rows_per_group: int = 50_000) -> DataFrame:
    """(id, copy, tokens, piece, pieces, piece_tokens, container, container_length) - every item, whole.

    An item above ``capacity`` fills containers of its own and its rest is packed like any other; no other item is
    divided. Items of one id and size are counted first (map-side) and then dealt to groups of about ``rows_per_group`` items: to one
    by a hash of id and size and, where they repeat, evenly to those after it; so the groups are the same on
    every run and a repeated row that is a third of all is spread over all of them. Each group is packed by best-fit decreasing; a
    container belongs to one group. Loss against one global packing: less than one container's slack per size class and group.
    Items of size 0 or null size take no space and share any container. Repeated ids are separate items, told apart by
    ``copy`` where their sizes are equal, too. An empty table gives no rows. ``lengths`` must end in ``capacity``.
    """
    assert max(lengths) == capacity
    it = items.select(F.col(id_col).alias("id"), F.coalesce(size, F.lit(0)).cast("bigint").alias("tokens"))
    it = cut(it.groupBy("id", "tokens").agg(F.count(F.lit(1)).alias("n")))
    total = it.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // rows_per_group))
    shares = F.least(F.col("n"), F.lit(groups))
    dealt = it.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1)))
    each, more = F.floor(F.col("n") / shares), F.col("n") % shares
    dealt = dealt.select("id", "tokens", F.pmod(F.xxhash64("id", "tokens") + F.col("at"), F.lit(groups)).cast("int").alias("g"), (F.col("at") * each + F.least("at", more)).alias("first"), (each + (F.col("at") < more).cast("bigint")).alias("copies"))
    fit = tuple(lengths)

    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        g, copies = int(pdf["g"].iloc[0]), pdf["copies"].to_numpy()
        pdf = pdf.assign(key=pdf["id"].astype(str)).loc[np.repeat(pdf.index, copies)]
        pdf["copy"] = pdf["first"].to_numpy() + np.concatenate([np.arange(c) for c in copies])
        pdf = pdf.sort_values(["tokens", "key", "copy"], ascending=[False, True, True], kind="stable", ignore_index=True)
        full, rest = np.divmod(pdf["tokens"].to_numpy(np.int64), capacity)
        part = (rest > 0) | (full == 0)
        item = np.repeat(np.arange(len(pdf)), full)
        piece = np.concatenate([np.arange(f) for f in full[full > 0]]) if len(item) else np.empty(0, np.int64)
        own = pd.DataFrame({"item": item, "piece": piece, "piece_tokens": capacity, "container": [f"w-{g}-{i}-{p}" for i, p in zip(item, piece)], "container_length": capacity})
        last = pd.DataFrame({"item": np.flatnonzero(part), "piece": full[part], "piece_tokens": rest[part]}).sort_values(["piece_tokens", "item"], ascending=[False, True], kind="stable", ignore_index=True)
        where, final = best_fit(last["piece_tokens"].to_numpy(), fit)
        out = pd.concat([own, last.assign(container=[f"m-{g}-{b}" for b in where], container_length=final[where])], ignore_index=True)
        at = out["item"].to_numpy()
        return pd.DataFrame({"id": pdf["id"].to_numpy()[at], "copy": pdf["copy"].to_numpy()[at], "tokens": pdf["tokens"].to_numpy()[at], "piece": out["piece"], "pieces": (full + part)[at], "piece_tokens": out["piece_tokens"], "container": out["container"], "container_length": out["container_length"].astype("int32")})

    kind = dict(it.dtypes)["id"]
    return dealt.groupBy("g").applyInPandas(pack_group, f"id {kind}, copy bigint, tokens bigint, piece bigint, pieces bigint, piece_tokens bigint, container string, container_length int")


def divided(packed: DataFrame) -> DataFrame:
    """(id): items whose pieces the packing put into more than one container."""
    n = packed.groupBy("id", "copy", "tokens").agg(F.min("container").alias("a"), F.max("container").alias("b"))
    return n.where("a <> b").select("id").distinct()


def packing_checks(packed: DataFrame) -> DataFrame:
    """One row: items, their tokens, containers filled beyond their length, tokens placed, items divided though they fit, and the share of the space used."""
    bins = packed.groupBy("container").agg(F.sum("piece_tokens").alias("used"), F.max("container_length").alias("space")).agg(F.count_if(F.col("used") > F.col("space")).alias("overfull"), F.sum("used").alias("placed"), (F.sum("used") / F.sum("space")).alias("fill"))
    items = packed.groupBy("id", "copy", "tokens").agg(F.count(F.lit(1)).alias("pieces"), F.max("container_length").alias("longest")).agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("longest"))).alias("divided_though_fitting"))
    return items.crossJoin(bins)  # one row each


def packing_report(packed: DataFrame) -> DataFrame:
    """Per container length: containers, tokens, space and the share of it that is used."""
    bins = packed.groupBy("container", "container_length").agg(F.sum("piece_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    return bins.groupBy("container_length").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.sum("container_length").alias("space"), F.sum("pieces").alias("pieces")).withColumn("fill", F.col("tokens") / F.col("space"))
