import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from revlens.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, node string, slice int, key string, turns int, depth long, base int"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Every node from lists of tuples: (conv_id, turn, role, text) rows, no ties but equal turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    told = {c: [(r, t) for _, _, r, t in sorted(own[c])] for c in own}
    rebuilt = {}
    for c in told:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(told.get(c - c % 5, [])[:h] + told[c][h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(int)
    for prefix in members:
        if prefix:
            children[prefix[:-1]] += 1
    out = []
    for prefix, convs in members.items():
        below = [q for q in members if q[: len(prefix)] == prefix]
        ends = sorted(c for c in convs if rebuilt[c] == prefix)
        out.append((
            min(convs), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(convs), children[prefix],
            sum(1 for q in below if not children[q]),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, "k", 2, 3, 4) for r in rows], SCHEMA)


def result(df):
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=str)


def talks(rng, n, vocabulary=4, longest=7):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, longest + 1)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice([None, *(f"t{k} é" for k in range(vocabulary))])))
    return rows


@pytest.mark.parametrize("slice_turns", [1, 7, 40, P.SLICE_TURNS])
def test_brute_force(spark, slice_turns):
    rng = random.Random(slice_turns)
    rows = talks(rng, 90)
    rows += [(c, t, "user", f"common {t}") for c in range(200, 260) for t in range(3)]  # a third alike
    rows += [(c, t, "user", f"common {t}") for c in range(300, 330) for t in range(3 + c % 4)]
    rows += [(401, t, "user", str(t % 3)) for t in range(300)]  # a long one
    rows += [(403, None, "user", "null turn first"), (403, 0, "user", "then this"), (407, 0, None, None)]
    assert result(P.shared_prefixes(spark, frame(spark, rows).repartition(5), slice_turns)) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "lost"), (2, 3, "", ""), (2, 3, None, None),
        (6, -1, "user", "x" * 200_000), (11, 0, "ab", "c"), (12, 0, "a", "bc"), (-3, 0, "user", "below zero"), (7, None, None, None),
    ]
    table = [r if r[0] != -3 else r for r in rows]
    got = result(P.shared_prefixes(spark, frame(spark, table)))
    assert [g for g in got if g[1] == 0][0][3] == 7
    positive = [r for r in rows if (r[0] or 0) >= 0]
    assert result(P.shared_prefixes(spark, frame(spark, positive))) == brute(positive)


def test_empty(spark):
    assert P.shared_prefixes(spark, frame(spark, [])).collect() == []


def test_layouts_grow():
    root = P.Node(b"")
    for byte in range(256):
        P.insert(root, bytes([byte, 7]), [0], byte)
        assert root.layout == next(n for n in P.LAYOUTS if n > byte)
        assert all(root.child(b).path == bytes([b, 7]) for b in range(byte + 1))
        assert byte == 255 or root.child(byte + 1) is None
    P.insert(root, bytes([9, 8]), [0], 300)
    fork = root.child(9)
    assert fork.path == b"\x09" and {k.path for k in fork.children()} == {b"\x07", b"\x08"}


def test_common_length():
    rng = random.Random(1)
    for _ in range(300):
        a = bytes(rng.randrange(2) for _ in range(rng.randrange(9)))
        b = bytes(rng.randrange(2) for _ in range(rng.randrange(9)))
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert P.common_length(a, b) == n
