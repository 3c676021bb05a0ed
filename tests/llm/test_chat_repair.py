import functools
import itertools
import random

import numpy as np
import pytest

from slantspark.llm import chat_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, stretch string, seq int"


def legal(roles):
    body = roles[1:] if roles[:1] == ["system"] else roles
    return bool(body or not roles) and len(body) % 2 == 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(body)) and roles != ["system"]


def brute_cost(given):
    """Cheapest repair by trying every relabelling and every merge, then the inserted turns a legal order needs."""
    best = 10 ** 9
    for labels in itertools.product(("system", "user", "assistant"), repeat=len(given)):
        cost = sum(2 for a, b in zip(given, labels) if a != b)
        for cuts in itertools.product((0, 1), repeat=max(len(labels) - 1, 0)):
            if any(not c and labels[k] != labels[k + 1] for k, c in enumerate(cuts)):
                continue
            runs = [labels[0]] if labels else []
            for k, c in enumerate(cuts):
                if c:
                    runs.append(labels[k + 1])
            inserted = fill(runs)
            if inserted is not None:
                best = min(best, cost + sum(1 for c in cuts if not c) + 3 * inserted)
    return 0 if not given else best


def fill(runs):
    if "system" in runs[1:]:
        return None
    count, last = 0, None
    for r in runs:
        if r == "user" and last == "user" or r == "assistant" and last != "user":
            count += 1
        last = r
    return count + {"assistant": 0, "user": 1, "system": 2}[last]


def cost_of(rows):
    return sum({"keep": 0, "merge": 1, "relabel": 2, "relabel+merge": 3, "insert": 3}[r.action] for r in rows)


@pytest.mark.parametrize("stretch", [256, 2])
def test_cheapest_and_legal(spark, stretch):
    rng = random.Random(7)
    convs = {c: [rng.choice(["system", "user", "assistant", "bot"]) for _ in range(rng.randint(1, 5))] for c in range(120)}
    convs[200] = ["user", "assistant"] * 40
    rows = [(c, k, role, f"t{c}.{k}", "x", 1) for c, roles in convs.items() for k, role in enumerate(roles)]
    got = cr.format_chats(spark.createDataFrame(rows, SCHEMA), stretch=stretch).cache()
    by_conv = {}
    for r in sorted(got.collect(), key=lambda r: (r.conv_id, r.stretch, r.seq)):
        by_conv.setdefault(r.conv_id, []).append(r)
    rendered = {r.conv_id: r.rendered for r in cr.render(got).collect()}
    for c, roles in convs.items():
        found = by_conv[c]
        assert [r.turn for r in found if r.turn is not None] == list(range(len(roles)))
        written = [r.role for r in found if "merge" not in r.action]
        assert legal(written), (roles, written)
        if len(roles) <= 5:
            assert cost_of(found) == brute_cost(roles), (roles, [(r.role, r.action) for r in found])
        text = rendered[c]
        assert text.count("<|end|>") == len(written) and all(f"t{c}.{k}" in text for k in range(len(roles)))
        assert [x.split("|>")[0] for x in text.split("<|")[1:] if not x.startswith("end")] == written


def test_nulls_ties_and_empty_table(spark):
    rows = [(1, 0, None, None, "", 0), (1, 0, None, None, "", 0), (1, None, " USER ", "first", "", 0), (None, 5, "assistant", "lost", "", 0)]
    got = cr.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.stretch, r.seq))
    assert [(r.turn, r.role) for r in one] == [(None, "user"), (0, "assistant"), (0, "assistant")]
    assert [r.role for r in sorted((r for r in got if r.conv_id is None), key=lambda r: r.seq)] == ["user", "assistant"]
    assert cr.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_covers_every_turn(spark):
    from slantspark.llm import queries
    sf = "/root/testdata/sf0.001"
    got = queries.REGISTRY["op6_chat_repair"](spark, sf)
    assert got.where("action <> 'insert'").count() == spark.read.parquet(f"{sf}/conversations.parquet").count()


def test_stretches_are_bounded_whatever_the_turn_numbers_are(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(None, rng.choice([None, 0, 0, 1]), rng.choice(["user", "assistant", "bot"]), f"t{k % 40}", "x", 1) for k in range(700)]
    rows += [(None, 0, "user", "same", "x", 1)] * 300 + [(3, 7, "user", "hi", "x", 1)]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(5)
    one = sorted(cr.format_chats(turns, stretch=10_000).collect(), key=lambda r: (r.conv_id is not None, r.stretch, r.seq))
    monkeypatch.setattr(cr, "BLOCK", 4)
    got = sorted(cr.format_chats(turns, stretch=16).collect(), key=lambda r: (r.conv_id is not None, r.stretch, r.seq))
    sizes = {}
    for r in got:
        if r.action != "insert":
            sizes[r.conv_id, r.stretch] = sizes.get((r.conv_id, r.stretch), 0) + 1
    assert max(sizes.values()) == 16 and len(sizes) == 64
    assert cost_of(got) == cost_of(one)
    assert legal([r.role for r in got if "merge" not in r.action and r.conv_id is None])
    text = lambda found: [(r.turn, r.segment.split("|>\n")[-1].replace("\n<|end", "").strip()) for r in found if r.action != "insert"]
    assert text(got) == text(one)


def plain_repair(given, table):
    """The chosen repair by trying every way: least cost, then the least list of (rank, role) of its turns."""
    ways = {cr.START: (0, [])}
    for g in given:
        nxt = {}
        for s, (cost, path) in ways.items():
            for r in range(4):
                if table[g][s][r]:
                    new = (cost + table[g][s][r][0], path + [(table[g][s][r][1], r)])
                    nxt[r] = min(nxt.get(r, new), new)
        ways = nxt
    return [r for _, r in min((cost + cr.FINISH[s][0], path) for s, (cost, path) in ways.items())[1]]


def test_ties_do_not_depend_on_the_cuts():
    rng, table, memo = random.Random(11), cr.steps(), {}
    matrices = cr._matrices(table)
    for trial in range(1500):
        given = [rng.choice([1, 2, 3, 3, 2, 0]) for _ in range(rng.randint(1, 40))]
        cuts = sorted({0, len(given), *(rng.randint(0, len(given)) for _ in range(rng.randint(0, 12)))})
        parts = [given[a:b] for a, b in zip(cuts, cuts[1:])]
        states = cr.choose_states([cr.stretch_matrix(p, matrices, memo) for p in parts])
        got = [r for p, a, b in zip(parts, states, states[1:]) for r, *_ in cr.repair(p, a, b, table)]
        assert got == plain_repair(given, table), (given, cuts)
        half = len(parts) // 2                                     # blocks of stretches first, then the stretches of each
        blocks = [g for g in (parts[:half], parts[half:]) if g]
        product = lambda ms: functools.reduce(cr.compose, ms, cr.IDENTITY)
        ends = cr.choose_states([product([cr.stretch_matrix(p, matrices, memo) for p in g]) for g in blocks])
        inner = [cr.START]
        for g, a, b in zip(blocks, ends, ends[1:]):
            inner += cr.choose_states([cr.stretch_matrix(p, matrices, memo) for p in g], a, b)[1:]
        assert inner == states
    assert len(memo) < 5000  # few different matrices, whatever the number of turns
    long = cr.stretch_matrix([2, 3, 3, 1, 0] * 4000, matrices, memo)
    assert np.array_equal(long, cr.compose(cr.stretch_matrix([2, 3, 3, 1, 0] * 1000, matrices, memo), cr.stretch_matrix([2, 3, 3, 1, 0] * 3000, matrices, memo)))


def test_same_rows_for_every_stretch(spark):
    rng = random.Random(3)
    convs = [["user", "assistant", "assistant", "assistant", "user", "assistant"]]
    convs += [[rng.choice(["system", "user", "assistant", "bot"]) for _ in range(rng.randint(1, 14))] for _ in range(60)]
    turns = spark.createDataFrame([(c, k, role, f"t{c}.{k}", "x", 1) for c, roles in enumerate(convs) for k, role in enumerate(roles)], SCHEMA)
    found = []
    for stretch in (2, 3, 4, 256):
        rows = sorted(cr.format_chats(turns, stretch=stretch).collect(), key=lambda r: (r.conv_id, r.stretch, r.seq))
        found.append([(r.conv_id, r.turn, r.role, r.action, r.segment) for r in rows])
    assert found[0] == found[1] == found[2] == found[3]
    assert [a for c, _, _, a, _ in found[0] if c == 0] == ["keep", "keep", "merge", "merge", "keep", "keep"]
