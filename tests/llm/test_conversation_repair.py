"""Repairs of conversations against a search over all cheapest audits as strings."""

import hashlib
import random

from quillspark.llm import conversation_repair as R

NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def _with_inserts(layer):
    """Every state with up to three inserts more: (cost, audit, turns) of all cheapest and some dearer ways."""
    out, now = {q: set(v) for q, v in layer.items()}, layer
    for _ in range(3):
        more = {}
        for p, ways in now.items():
            role, q = NEXT[p]
            more.setdefault(q, set()).update((c + 5, a + "I", t + (f"{role}:",)) for c, a, t in ways)
        for q, ways in more.items():
            out.setdefault(q, set()).update(ways)
        now = more
    return out


def brute(rows):
    """rows (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append(1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0)
        seen.add((role, text))
    layer = {0: {(0, "", ())}}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for p, ways in _with_inserts(layer).items():
            for c, a, t in ways:
                new.setdefault(p, set()).add((c + 2, a + "D", t))
                if fault in (0, 3):
                    c += 5 * (fault == 3)
                    if p in KEPT.get(role[:1], {}):
                        new.setdefault(KEPT[role[:1]][p], set()).add((c, a + "K", (*t, f"{role}:{text}")))
                    ask, q = NEXT[p]
                    new.setdefault(q, set()).add((c + 1, a + "R", (*t, f"{ask}:{text}")))
        layer = {q: {w for w in ways if w[0] == min(ways)[0]} for q, ways in new.items()}
    ends = _with_inserts(layer)
    cost, audit, turns = min(w for q in (0, 3) for w in ends.get(q, ()))
    at = [t for t, _, _ in rows if t is not None]
    gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def _expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest())
    return {c: brute(sorted(v, key=order)) for c, v in by.items()}


SCHEMA = "conv_id long, turn long, role string, text string, audit string, conv int"


def test_repair_equals_brute_force_at_any_partitioning(spark):
    rng = random.Random(3)
    texts = ["Hi.", "ok", "", " ", "Yes!", "no?  ", "a", "b.", None, "\t\x0b"]
    rows = [(None if c == 7 else c, rng.choice([None, k, k, k]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice([*texts, f"t{k}.", f"x{k}"])) for c in range(50) for k in range(rng.randint(1, 7))]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA)
    want = _expected(rows)
    originals = df.unionByName(spark.createDataFrame([(99, 0, "user", "left out", "", 0)], SCHEMA))
    want[99] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    # parts of a conversation lie in one partition, in several, or each turn in its own
    for each in (1000, 9, 1):
        assert {r[0]: tuple(r)[1:] for r in R.repair(originals, df, each).collect()} == want


def test_long_conversation_is_dealt_out(spark):
    """20,000 turns of one conversation over 20 partitions give what one partition gives, and an audit that keeps the form."""
    rng = random.Random(5)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice(["same.", f"turn {k}.", f"turn {k}"]), "", 0) for k in range(20_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    (one,), (many,) = (R.plan(df, each).collect() for each in (100_000, 1000))
    assert one == many and len(one.audit.replace("I", "")) == 20_000
    turns = R.repaired(df, spark.createDataFrame([many], R.plan(df).schema)).orderBy("place").collect()
    initials = "".join(t.role[0] for t in turns)
    assert initials == "ua" * (len(initials) // 2) and "".join(t.edit for t in turns) == one.audit.replace("D", "")


def test_hot_row_and_empty_table(spark):
    """One turn said thousands of times is kept once."""
    df = spark.createDataFrame([(1, 0, "user", "Hello.", "", 0)] * 3000 + [(1, 1, "assistant", "Yes.", "", 0)], SCHEMA)
    (r,) = R.repair(df, df, 500).collect()
    assert (r.duplicate, r.cost, r.audit) == (2999, 5998, "K" + "D" * 2999 + "K")
    assert R.repair(df.where("conv_id < 0"), df.where("conv_id < 0")).collect() == []
    (r,) = R.repair(df, df.where("conv_id < 0")).collect()
    assert (r.audit, r.cost, r.repaired_sha256) == ("", 0, hashlib.sha256(b"").hexdigest())


def test_codes_are_prefix_free():
    assert not any(a != b and b.startswith(a) for a in R.CODES for b in R.CODES)
