"""Packing of documents into sequences of a fixed number of tokens.

Lengths are whole numbers up to the capacity, so however many pieces there are, their histogram has at most
``capacity`` bars. On it the driver solves the configuration linear program: cover every length's pieces by as few
filled sequences as it can, a configuration being one multiset of lengths that fits. Multiplicative weights do it
(``_cover_by_weights``) on a pool of configurations: each step uses the one worth most, and the weights of the lengths
in it fall exponentially with their coverage. A knapsack dynamic program prices all configurations under the weights of
the pool's best bound (``_richest``): by duality, needs times weights over the best price bounds the optimum from
below, and the richest configuration with each length joins the pool, round by round until neither bound nor cost moves.
Where lengths are many and fill sequences without waste, weights stay at the lengths themselves, and a second way to cover is
nearer to the optimum than steps of weights are: configurations within a slack of the best price, used as far as needs
allow (``_cover``). It is tried under the lengths and under the best bound's weights; ``solve`` keeps what costs least.

Rounding (``rounded``) uses configurations a whole number of times and packs what remains best-fit, again by whole bars
of the histogram. It tries several shares of the solution, 0 among them, and keeps what needs the fewest sequences, so
the plan is never worse than best fit alone, and of equals the one with the largest share. The plan is a table of slots
(length, first rank, last rank, sequence number, offset), of a size that depends on the capacity alone, and each piece
finds its place from its rank among the pieces of its length.

Edge cases: a null or empty text is one piece with the end id; a document beyond the capacity is cut into full pieces,
of which the first may be shorter; equal pieces and repeated rows get different places; a row without id is packed too;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import store
from quillspark.llm import textvec as V
from quillspark.llm import tokens as T

#: Stages of a round's coverage, how far it tells near ties apart, slacks in tokens of its last stages, least gain of a pass.
STAGES, TIE, SLACKS, GAIN = 4, 1e-4, (0.4, 1, 2, 4), 0.002
#: Rounds of pricing, steps of the weights that a round is planned for, and bounds of the weights' rate.
ROUNDS, STEPS, RATES = 8, 20_000, (0.01, 0.5)
#: Shares of the solution and what is added before rounding down, as ``rounded`` tries them.
SHARES, ADDED = (1.0, 0.9, 0.5, 0.1), (0.0, 0.5, 1.0)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def knapsack(value: np.ndarray, capacity: int) -> np.ndarray:
    """Worth of the best multiset of lengths within each capacity; value[l] is the worth of length l."""
    lengths = np.flatnonzero(value > 0)
    worth, upto = value[lengths], np.searchsorted(lengths, np.arange(capacity + 1), "right")
    best = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        k = upto[c]
        best[c] = max(best[c - 1], (best[c - lengths[:k]] + worth[:k]).max()) if k else best[c - 1]
    return best


def _configuration(first: int, lengths: np.ndarray, worth: np.ndarray, left: np.ndarray, share: np.ndarray, best: np.ndarray, least: float, capacity: int) -> dict[int, int] | None:
    """A multiset of open lengths (numbers among ``lengths``) with ``first`` in it, worth ``least`` or more, or None. Of
    the lengths that keep this within reach it takes the one that lags most, of equals the longest."""
    items, room, have = {first: 1}, capacity - int(lengths[first]), worth[first]
    if have + best[room] < least:
        return None
    while room >= lengths[0]:
        k = int(np.searchsorted(lengths, room, "right"))
        reach = np.flatnonzero((best[room - lengths[:k]] + worth[:k] + have >= least) & (share[:k] > 1e-9))
        if not len(reach):
            break
        j = int(reach[np.argmax(left[reach] + 1e-3 * lengths[reach] / capacity)])
        items[j] = items.get(j, 0) + 1
        have += worth[j]
        room -= int(lengths[j])
    return items if have >= least else None


def _cover(lengths: np.ndarray, need: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[dict[tuple[tuple[int, int], ...], float], np.ndarray]:
    """Configurations within the slacks of the best price under ``weight`` and how often each is used, covering no length
    beyond its need, and the share of each length's need that they leave. A round's weights tell only near ties apart."""
    covered, used = np.zeros(len(lengths)), {}
    for aim, slack in [*((k / STAGES, SLACKS[0]) for k in range(1, STAGES + 1)), *((1.0, e) for e in SLACKS)]:
        gained = np.inf
        while gained >= GAIN * (need * lengths).sum() * aim / STAGES:
            left = aim - covered / need
            if (left <= 1e-9).all():
                break
            value = np.zeros(capacity + 1)
            value[lengths] = weight * np.exp(TIE * np.clip(left / left.max(), 0, 1))
            price = knapsack(value, capacity)[capacity]
            # prices of configurations of lengths that still lag
            still = value.copy()
            still[lengths[left <= 1e-9]] = 0
            best, least, gained = knapsack(still, capacity), price * (1 - slack / capacity), 0.0
            worth, share = value[lengths], left.copy()
            for i in range(len(lengths) - 1, -1, -1):
                while share[i] > 1e-9:
                    items = _configuration(i, lengths, worth, share, share, best, least, capacity)
                    if items is None:
                        break
                    times = min(share[j] * need[j] / a for j, a in items.items())
                    for j, a in items.items():
                        share[j] -= a * times / need[j]
                        covered[j] += a * times
                        gained += a * times * float(lengths[j])
                    key = tuple(sorted(items.items()))
                    used[key] = used.get(key, 0.0) + times
    return used, np.clip(1 - covered / need, 0, None)


def _richest(lengths: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[float, list[tuple[tuple[int, int], ...]]]:
    """The best price under ``weight``, and for each length a configuration worth most of those that have it."""
    value = np.zeros(capacity + 1)
    value[lengths] = weight
    best, out = knapsack(value, capacity), []
    for i, length in enumerate(lengths):
        items, room = {i: 1}, capacity - int(length)
        while best[room] > 0:
            k = int(np.searchsorted(lengths, room, "right"))
            j = int(np.argmax(best[room - lengths[:k]] + weight[:k]))
            if best[room - lengths[j]] + weight[j] < best[room] * (1 - 1e-12):
                room = int(np.searchsorted(best, best[room]))  # the same worth in less room
                continue
            items[j] = items.get(j, 0) + 1
            room -= int(lengths[j])
        out.append(tuple(sorted(items.items())))
    return float(best[capacity]), out


def _cover_by_weights(pool: list[tuple[tuple[int, int], ...]], need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multiplicative weights on a pool of configurations: how often each is used so that all needs are met, and the weights
    that price the pool's best bound. Each step uses the configuration worth most as often as its scarcest length needs; a
    length's weight falls exponentially with its coverage and is 0 once that reaches the target."""
    m = len(need)
    a = np.zeros((m, len(pool)))
    for k, config in enumerate(pool):
        for j, n in config:
            a[j, k] = n
    rate = float(np.clip(np.sqrt(m * np.log(m + 1) / STEPS), *RATES))
    target = np.log(m + 1) / rate**2
    support = [np.array([j for j, _ in c]) for c in pool]
    much = [np.array([n for _, n in c]) / need[s] for c, s in zip(pool, support, strict=True)]
    y, covered, used = 1 / need, np.zeros(m), np.zeros(len(pool))
    best = 0.0, y
    step = 0
    while covered.min() < target:
        if step % 512 == 0:  # sums kept up by differences would lose what is small by now
            worth, total = a.T @ y, float(need @ y)
        step += 1
        k = int(np.argmax(worth))
        if total / worth[k] > best[0] * (1 + 1e-6):
            best = total / worth[k], y.copy()
        s = support[k]
        most = much[k][y[s] > 0].max()
        grown = much[k] / most
        covered[s] += grown
        used[k] += 1 / most
        new = np.where(covered[s] < target, y[s] * np.exp(-rate * grown), 0.0)
        change = new - y[s]
        y[s] = new
        total += float(change @ need[s])
        worth += change @ a[s]
    return used / covered.min(), best[1]


def solve(count: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Configurations with how often each is used, covering lengths at most as far as they need, and a bound from below
    on any solution."""
    lengths = np.flatnonzero(count)
    if not len(lengths):
        return [], 0.0
    need, at = count[lengths].astype(float), {int(x): j for j, x in enumerate(lengths)}
    found: list[tuple[float, dict]] = []

    def offer(uses: dict[tuple[tuple[int, int], ...], float]) -> None:
        """Keeps the uses cut to the needs, with what they and best fit of the rest cost."""
        left, own = need.copy(), {}
        for config, times in sorted(uses.items(), key=lambda u: (-u[1], u[0])):
            times = min([times, *(left[j] / n for j, n in config)])
            if times > 1e-9:
                own[config] = times
                for j, n in config:
                    left[j] -= n * times
        rest = np.zeros_like(count)
        rest[lengths] = np.ceil(left - 1e-6).astype(np.int64)
        found.append((sum(own.values()) + sum(m for _, m in best_fit(rest, capacity)), own))

    volume = lengths / capacity
    price, configs = _richest(lengths, volume, capacity)
    bound, weight = float(need @ volume) / price, volume
    offer(_cover(lengths, need, volume, capacity)[0])
    greedy = [tuple((at[x], items.count(x)) for x in sorted(set(items))) for items, _ in best_fit(count, capacity)]
    pool = dict.fromkeys([*greedy, *found[0][1], *configs])
    for _ in range(ROUNDS):
        if found[-1][0] <= np.ceil(bound - 1e-6):
            break
        known = bound, min(f[0] for f in found)
        used, y = _cover_by_weights(list(pool), need)
        offer(dict(zip(pool, used.tolist(), strict=True)))
        price, configs = _richest(lengths, y, capacity)
        if float(need @ y) / price > bound:
            bound, weight = float(need @ y) / price, y / price
        pool.update(dict.fromkeys(configs))
        if (bound, min(f[0] for f in found)) == known:
            break
    if weight is not volume:
        offer(_cover(lengths, need, weight, capacity)[0])
    uses = min(found, key=lambda f: (f[0], -sum(f[1].values())))[1]
    return [({int(lengths[j]): a for j, a in c}, x) for c, x in uses.items()], bound


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on a histogram: (lengths in a sequence, number of such sequences)."""
    groups: dict[int, list[tuple[list[int], int]]] = {}
    for length in range(capacity, 0, -1):
        n = int(count[length])
        while n:
            room = next((r for r in range(length, capacity) if groups.get(r)), capacity)
            items, many = groups[room].pop() if room < capacity else ([], n)
            fits = room // length
            full = min(many, n // fits)
            if full:
                groups.setdefault(room - fits * length, []).append((items + [length] * fits, full))
                n -= full * fits
            left = many - full
            if left and n:
                k = min(n, fits)
                groups.setdefault(room - k * length, []).append((items + [length] * k, 1))
                n, left = n - k, left - 1
            if left and room < capacity:
                groups.setdefault(room, []).append((items, left))
    return [g for same in groups.values() for g in same]


def rounded(count: np.ndarray, capacity: int) -> tuple[list[tuple[list[int], int]], dict[str, float]]:
    """Sequences (lengths, how many) for all pieces, and ``bound``, the least number of sequences by the dual program,
    ``solution``, how many of them the program's configurations make, and ``best_fit``, what best fit alone needs."""
    left = count.astype(np.int64).copy()
    full = [([capacity], int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    uses, bound = solve(left, capacity)
    uses.sort(key=lambda x: (-x[1], sorted(x[0].items())))
    plain = best_fit(left, capacity)
    alone = sum(m for _, m in plain)
    best = (alone, 0, plain)
    for share in SHARES:
        for more in ADDED:
            rest, made = left.copy(), []
            for config, times in uses:
                m = min([int(share * times + more - 1e-9), *(int(rest[x]) // a for x, a in config.items())])
                if m > 0:
                    for x, a in config.items():
                        rest[x] -= m * a
                    made.append(([x for x, a in sorted(config.items(), reverse=True) for _ in range(a)], m))
            own = sum(m for _, m in made)
            made += best_fit(rest, capacity)
            best = min(best, (sum(m for _, m in made), -own, made), key=lambda b: b[:2])
    n_full = sum(m for _, m in full)
    return full + best[2], {"bound": np.ceil(bound - 1e-6) + n_full, "solution": -best[1], "best_fit": alone + n_full}


def plan(count: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Slots for count[l] pieces of each length l: for pieces of ``length`` with ranks from ``rank`` on, the sequence
    of the first and the offset in it; ordered by (length, rank)."""
    made, _ = rounded(count, capacity)
    next_rank = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for items, m in made:
        offset = 0
        for x in items:
            rows.append((x, int(next_rank[x]), sequence, offset))
            next_rank[x] += m
            offset += x
        sequence += m
    if (next_rank != count).any():
        raise AssertionError("the plan doesn't place every piece")
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T, strict=True)) | {"sequences": np.array([sequence])}


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of every document, numbered among those of their length in their task (``part``, ``rank``)."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seen = T.encoder(tokenizer, False), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            for lo, hi, data, off in V.chunks(b.column("text"), T.TOKEN_CHUNK):
                ids, size = enc.encode(data, off)
                size = size + 1
                upto = np.concatenate(([0], np.cumsum(size)))
                flat = np.empty(int(upto[-1]), np.uint32)
                last = np.zeros(len(flat), bool)
                last[upto[1:] - 1] = True
                flat[last], flat[~last] = end_id, ids
                n = -(-size // capacity)
                row = np.repeat(np.arange(hi - lo), n)
                number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                short = size - (n - 1) * capacity
                start = np.where(number == 0, 0, short[row] + (number - 1) * capacity)
                length = np.where(number == 0, short[row], capacity)
                order = np.argsort(length, kind="stable")
                of = np.bincount(length, minlength=capacity + 1)
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - np.repeat(np.cumsum(of) - of, of) + np.repeat(seen, of)
                seen += of
                begin = upto[row] + start
                crcs = [T.crc(flat[x : x + y]) for x, y in zip(begin.tolist(), length.tolist(), strict=True)]
                cols = [b.column("doc_id").slice(lo, hi - lo).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(begin, upto[-1]).astype(np.int32)), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece, and with ``with_ids`` its ids."""
    cut = store.kept(pieces(docs, tokenizer, capacity=capacity, end_id=end_id, with_ids=with_ids), "pieces")
    bars = store.kept(cut.groupBy("length", "part").count(), "bars")
    # one row for each length: at most ``capacity`` rows reach the driver
    count = np.zeros(capacity + 1, np.int64)
    for r in bars.groupBy("length").agg(F.sum("count").alias("n")).collect():
        count[r["length"]] = r["n"]
    slots = plan(count, capacity)
    key = slots["length"] * (int(count.max(initial=0)) + 1) + slots["rank"]
    scale = int(count.max(initial=0)) + 1

    def place(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("before").to_numpy()
            k = np.searchsorted(key, length * scale + rank, "right") - 1
            table = pa.Table.from_batches([b]).drop_columns(["part", "rank", "before"])
            table = table.append_column("sequence_id", pa.array(slots["sequence"][k] + rank - slots["rank"][k])).append_column("offset", pa.array(slots["offset"][k]))
            yield from table.to_batches()

    # lengths x partitions rows: the engine broadcasts them only below its threshold and else shuffles both sides by key
    before = bars.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    names = [x.split()[0] for x in out.split(", ")[: -2]]
    return cut.join(before, ["length", "part"]).select(*names, "part", "rank", "before").mapInArrow(place, out)
