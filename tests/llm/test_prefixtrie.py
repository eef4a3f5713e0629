import hashlib
import math
import random
import zlib

import duckdb
import pytest

from textweir.llm import prefixtrie as trie

SCHEMA = "conv_id long, turn long, role string, text string, size string, d long"


def rebuilt(rows):
    """Conversations by the contract, from rows (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)} {role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    return out


def brute(convs):
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves, saved = (0, 0) if kids.get(p) else (1, 0)
        for k in kids.get(p, []):
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved + (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)

    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        leaves, saved = below(p)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)
    turns = trie.digested_turns(df)
    ids = turns.select("conv_id").distinct()
    return sorted(tuple(r) for r in trie.prefix_trie(trie.rebuilt(turns, ids), ids).select(COLUMNS).collect())


def rows_of(seed, n=120):
    random.seed(seed)
    out = []
    for c in [-3, -1, *random.sample(range(400), n)]:
        shape = random.random()
        texts = ["hot", "hot", "b"] if shape < 0.3 else [random.choice(["", "a", "b", "é", None]) for _ in range(random.randint(1, 12))]
        out += [(c, k if random.random() < 0.9 else None, random.choice(["user", None]) if shape > 0.3 else "user", t) for k, t in enumerate(texts)]
    return [*out, (None, 0, "user", "nobody's"), *out[:3]]


@pytest.mark.parametrize("ranges", [400, 3000, trie.RANGE_BYTES])
def test_trie_is_brute_force(spark, monkeypatch, ranges):
    """Ranges of a row or a few: paths, copies of a conversation and ends go on over many of them."""
    monkeypatch.setattr(trie, "RUN_BYTES", 2000)
    monkeypatch.setattr(trie, "RANGE_BYTES", ranges)
    rows = rows_of(ranges)
    assert found(spark, rows) == brute(rebuilt(rows))


def test_long_and_few_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "RANGE_BYTES", 3000)
    same = [(c, t, "user", "ok") for c in (5, 10, 20) for t in range(60 + c)]
    for rows in (same + [(7, 0, "user", "x" * 300_000)], [(3, None, None, None)], []):
        assert found(spark, rows) == brute(rebuilt(rows))


def test_conversation_without_turns_of_its_own(spark):
    """Its base is absent and has nothing to give, and all its own turns are within its first h."""
    c = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    assert found(spark, [(c, 0, "user", "gone")]) == brute({c: []}) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_loser_tree_compares_behind_equal_prefixes_only():
    random.seed(2)
    turn = lambda n: n.to_bytes(trie.WIDTH, "big")
    rows = [(b"".join(turn(0) for _ in range(200)) + b"".join(turn(random.randint(1, 3)) for _ in range(random.randint(0, 4))), k) for k in range(300)]
    for k in (1, 2, 7, 16):
        runs = []
        for part in range(k):
            own = sorted(rows[part::k])
            runs.append([(trie.common_turns(own[i - 1][0], key) if i else 0, key, c) for i, (key, c) in enumerate(own)])
        tree = trie.LoserTree(runs)
        out = list(tree)
        assert [r[1:] for r in out] == sorted(rows)
        assert all(r[0] == trie.common_turns(a[1], r[1]) for a, r in zip(out, out[1:]))
        assert tree.compared < 200 * k + 15 * len(rows)  # 200 shared turns are gone through once a run
    assert list(trie.LoserTree([])) == [] and list(trie.LoserTree([[], []])) == []


def test_sql_is_brute_force():
    rows = rows_of(9)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({trie.OP12_SQL})").fetchall()) == brute(rebuilt(rows))
