"""Problem 6: filling fixed-capacity containers with items.

Texts are sized in tokens of a public tokenizer, whole texts, in Arrow batches. Items are dealt at random into groups of
bounded size; within a group, bin completion searches for the fewest containers: around the largest item left, all
undominated fillings of the rest of its container are tried in order of waste. A filling is dominated if an item not in it
fits beside it, or could take the place of a smaller item or of several together. Fillings that waste more than the best
packing known allows are pruned, as are sets of items left that were met before with no more waste; best-fit-decreasing is the first packing known, and
a bound that counts what large items leave shut ends the search where it is reached. Fillings are generated one by one from
the sums that the items can make, so none is left out and none is looked for in vain.

The search is exact. As the problem is hard, it has a budget of steps for each group (GROUP_STEPS; None: no budget): where
that ends a search, the best packing found stands and its containers are marked as not proved to be the fewest.

Defined cases. A text larger than a container is cut into full containers and one rest, which is packed like any item;
no other text is split. Empty text: an item of 0 tokens, in a container like any other. Null text: no item. Repeated
rows are items of their own. Equal sizes are packed in order of arrival. Empty table: empty result.
"""

from __future__ import annotations

import os
import random
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import parallelism, table

CAPACITY = 2_048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Items in a group, about; bounds a task's memory and search. A group leaves at most about one container part empty.
GROUP_ITEMS = 8_192
#: Steps of the search in a group: fillings tried, containers opened, and a step for every 64 sizes looked at in opening one.
GROUP_STEPS = 4_000_000
#: Sets of items known to lead nowhere, about; more are not remembered, which costs time only.
MEMORY = 500_000

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, once per process: tokenizers' JSON, or a sentencepiece model."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            m = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in m.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _loaded[path] = lambda texts: [len(x) for x in t.encode_batch(texts, add_special_tokens=False)]
    return _loaded[path]


def sizes(docs: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(key, tokens) of every row with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            out: list[int] = []
            part: list[str] = []
            held = 0
            for t in texts:  # bounded slices: the encodings of a slice are held at once
                part.append(t)
                held += len(t)
                if held > 200_000:
                    out += count(part)
                    part, held = [], 0
            out += count(part) if part else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int32())], names=[key, "tokens"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, f"{key} {kind}, tokens int")


def best_fit(items: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing over indexes of items, which are sizes in falling order."""
    room: list[tuple[int, int]] = []  # (room, container), in order
    out: list[list[int]] = []
    for i, n in enumerate(items):
        at = bisect_right(room, (n, -1))
        if at < len(room):
            left, k = room.pop(at)
        else:
            left, k = capacity, len(out)
            out.append([])
        out[k].append(i)
        insort(room, (left - n, k))
    return out


def lower_bound(items: list[int], capacity: int) -> int:
    """Fewest containers that any packing of items (sizes in falling order) needs.

    Items above half stand one to a container. For every size k up to half: those above capacity - k take nothing of size k
    or more beside them, so the items from k to half must fit into what the other large ones leave, or into new containers.
    """
    if not items:
        return 0
    before = [0]
    for n in items:
        before.append(before[-1] + n)
    falling = [-n for n in items]
    large = bisect_right(falling, -(capacity // 2 + 1))
    best = max(1, large, -(-before[-1] // capacity))
    for k in {n for n in items if 2 * n <= capacity}:
        shut = bisect_right(falling, -(capacity - k + 1))
        small = bisect_right(falling, -k)
        room = (large - shut) * capacity - (before[large] - before[shut])
        best = max(best, large + max(0, -(-(before[small] - before[large] - room) // capacity)))
    return best


def _sums(order: list[int], have: dict[int, int], room: int) -> list[int]:
    """For each place in order, the sums up to room that the sizes from there on can make, as the bits of a number."""
    mask = (1 << room + 1) - 1
    out = [1] * (len(order) + 1)
    bits = 1
    for i in range(len(order) - 1, -1, -1):
        s, left, k = order[i], min(have[order[i]], room // order[i]), 1
        while left > 0:
            k = min(k, left)
            bits |= bits << s * k
            left, k = left - k, 2 * k
        bits &= mask
        out[i] = bits
    return out


def _exact(order: list[int], have: dict[int, int], room: int, sums: list[int], start: int = 0) -> Iterator[tuple[int, ...]]:
    """All fillings of exactly the room, large sizes first; every branch entered leads to one."""
    if room == 0:
        yield ()
        return
    i = start
    while i < len(order) and sums[i] >> room & 1:
        s = order[i]
        for c in range(min(have[s], room // s), 0, -1):
            if sums[i + 1] >> room - c * s & 1:
                for rest in _exact(order, have, room - c * s, sums, i + 1):
                    yield (s,) * c + rest
        i += 1


def _wider(bits: int, width: int) -> int:
    """bits, each also at the width places above it."""
    done = 1
    while done <= width:
        step = min(done, width + 1 - done)
        bits |= bits << step
        done += step
    return bits


def dominated(filling: tuple[int, ...], waste: int, unused: int) -> bool:
    """Whether an unused size (a bit each) fits beside the filling, or in place of a smaller item or of several together."""
    if unused & (1 << waste + 1) - 1:
        return True
    one = several = 0
    for s in filling:
        several |= (one | several) << s
        one |= 1 << s
    return bool(_wider(several, waste) & unused) or waste > 0 and bool(_wider(one << 1, waste - 1) & unused)


def fillings(room: int, have: dict[int, int], order: list[int], allowed: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """All undominated fillings of a room with the sizes still there (order: falling) as (waste, sizes), least waste first.

    They are generated as they are asked for; `have` must be the same whenever the next one is.
    """
    live = [s for s in order if s <= room and have[s] > 0]
    sums = _sums(live, have, room)
    there = 0
    for s in live:
        there |= 1 << s
    for waste in range(min(allowed, room) + 1):
        if sums[0] >> room - waste & 1:
            for f in _exact(live, have, room - waste, sums):
                spent = 0
                for s in set(f):
                    if f.count(s) == have[s]:
                        spent |= 1 << s
                if not dominated(f, waste, there & ~spent):
                    yield waste, f


def solve(items: list[int], capacity: int, steps: int | None = GROUP_STEPS) -> tuple[list[list[int]], bool]:
    """The best packing found of items (sizes in falling order, none above the capacity), as lists of indexes, and whether it is proved to be the best."""
    best = best_fit(items, capacity)
    bound = lower_bound(items, capacity)
    if len(best) <= bound:
        return best, True
    where: dict[int, list[int]] = {}
    for i, n in enumerate(items):
        where.setdefault(n, []).append(i)
    have = {n: len(x) for n, x in where.items() if n > 0}
    order = sorted(have, reverse=True)
    total = sum(items)
    rnd = random.Random(0)
    mark = {s: rnd.getrandbits(128) for s in order}  # a set of items is known by the sum of its marks
    failed: dict[int, int] = {}  # the least waste with which a set of packed items was given up
    limit, record = len(best), None
    state = waste = 0
    left = steps if steps is not None else 1 << 62
    stack: list[list] = []  # [largest item, its fillings, the one tried now]

    def descend() -> bool:
        """Opens a container with the largest item left; False if there is none."""
        nonlocal left
        largest = next((s for s in order if have[s] > 0), None)
        if largest is None:
            return False
        have[largest] -= 1
        left -= 1 + len(order) // 64
        stack.append([largest, fillings(capacity - largest, have, order, (limit - 1) * capacity - total - waste), None])
        return True

    descend()
    while stack and limit > bound:
        largest, options, now = stack[-1]
        if now is not None:
            for s in now[1]:
                have[s] += 1
            state -= mark[largest] + sum(mark[s] for s in now[1])
            waste -= now[0]
        now = stack[-1][2] = next(options, None) if left > 0 else None
        if now is None or waste + now[0] > (limit - 1) * capacity - total:  # waste only rises: none of the rest can beat the packing known
            have[largest] += 1
            stack.pop()
            if left > 0 and (len(failed) < MEMORY or state in failed):
                failed[state] = min(waste, failed.get(state, waste))
            continue
        left -= 1
        for s in now[1]:
            have[s] -= 1
        state += mark[largest] + sum(mark[s] for s in now[1])
        waste += now[0]
        if (known := failed.get(state)) is not None and known <= waste:
            continue
        if not descend() and len(stack) < limit:
            limit, record = len(stack), [(g[0], *g[2][1]) for g in stack]
    proved = limit <= bound or left > 0
    if record is None:
        return best, proved
    out = [[where[n].pop() for n in c] for c in record]
    out[0] += where.get(0, [])
    return out, proved


def complete(items: list[int], capacity: int, steps: int | None = GROUP_STEPS) -> list[list[int]]:
    """The best packing found of items (sizes in falling order, none above the capacity), as lists of indexes."""
    return solve(items, capacity, steps)[0]


def pack(sized: DataFrame, key: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, rows: int | None = None) -> DataFrame:
    """(container, key, piece, pieces, start, tokens, proved): where each text, or each piece of one above the capacity, stands.

    rows: how many there are, where that is known; else they are counted, and sized once for it. proved: the group's
    containers are proved to be the fewest.
    """
    groups = max(1, -(-(sized.count() if rows is None else rows) // group_items))
    kind = dict(sized.dtypes)[key]
    # rows are dealt by their place in the scan, so equal keys or sizes do not gather in one group
    dealt = sized.withColumn("_g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        g = t.column("_g")[0].as_py()
        keys, tokens = t.column(key), t.column("tokens").to_numpy()
        full, rest = np.divmod(tokens, capacity)
        full = np.where((rest == 0) & (full > 0), full - 1, full)
        rest = tokens - full * capacity
        order = np.argsort(-rest, kind="stable")
        items = [int(x) for x in rest[order]]
        row, piece, container = [], [], []
        next_id = 0
        for i in np.flatnonzero(full):
            for p in range(int(full[i])):
                row.append(i), piece.append(p), container.append(next_id)
                next_id += 1
        packed, proved = solve(items, capacity)
        for c in packed:
            for j in c:
                i = int(order[j])
                row.append(i), piece.append(int(full[i])), container.append(next_id)
            next_id += 1
        row, piece = np.array(row, dtype=np.int64), np.array(piece, dtype=np.int32)
        start = piece.astype(np.int64) * capacity
        size = np.minimum(tokens[row].astype(np.int64) - start, capacity)
        return pa.table({
            "container": pa.array(np.array(container, dtype=np.int64) + (np.int64(g) << 32)), key: keys.take(pa.array(row)), "piece": pa.array(piece),
            "pieces": pa.array((full[row] + 1).astype(np.int32)), "start": pa.array(start.astype(np.int32)), "tokens": pa.array(size.astype(np.int32)), "proved": pa.array(np.full(len(row), proved)),
        })

    spark = sized.sparkSession
    most = max(4 * parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))  # several groups may share a partition
    spread = dealt.repartition(min(groups, most), "_g") if groups > 1 else dealt
    return spread.groupBy("_g").applyInArrow(run, f"container long, {key} {kind}, piece int, pieces int, start int, tokens int, proved boolean")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pack(sizes(docs, "doc_id", "text"), "doc_id", rows=docs.count())  # counted from the files' metadata; no text is read for it


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that fill more than one container alone."""
    return _packed(spark, sf_dir).where("pieces > 1 and piece = 0").select("doc_id")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's place: container, and piece where it had to be cut."""
    return _packed(spark, sf_dir)


def p6_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the fewest that could hold all tokens, the share of room left over, and containers of groups whose search its budget ended."""
    c = _packed(spark, sf_dir).groupBy("container").agg(F.sum("tokens").alias("t"), F.min("proved").alias("p"))
    n, t = F.count("*"), F.sum("t")
    return c.agg(n.alias("containers"), F.ceil(t / CAPACITY).alias("at_least"), F.max("t").alias("fullest"), F.round(1 - t / (n * CAPACITY), 6).alias("left_over"), F.count_if(~F.col("p")).alias("not_proved"))


QUERIES = {"p6_found": p6_found, "p6_containers": p6_containers, "p6_fill_report": p6_fill_report}
