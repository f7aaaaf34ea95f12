"""The Merkle manifest against a plain recomputation."""

import hashlib
import random
import zlib

from textloom.llm import op12_merkle_manifest as op

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, tree string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def fold_up(nodes, fan):
    """Root, and for each node the siblings of every level as (left, right)."""
    proofs = [[] for _ in nodes]
    owner = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = range(0, len(nodes), fan)
        for i, members in enumerate(owner):
            lo = i // fan * fan
            run = nodes[lo : lo + fan]
            for m in members:
                proofs[m].append((run[: i - lo], run[i - lo + 1 :]))
        nodes = [h(*nodes[lo : lo + fan]) for lo in runs]
        owner = [sum(owner[lo : lo + fan], []) for lo in runs]
    return nodes[0], proofs


def expected(rows, fan=16):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = [], []
    for s in sources:
        own = [(r, leaf(r)) for r in rows if r[1] == s]
        own.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append((own, *fold_up([x[1] for x in own], fan)))
    root, tops = fold_up([t[1] for t in trees], fan) if trees else (None, [])
    for (own, subroot, proofs), top in zip(trees, tops):
        for (row, digest), proof in zip(own, proofs):
            path = proof + top
            now = digest
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])
                now = leaf((*row[:4], low))
            for left, right in path:
                now = h(*left, now, *right)
            flat = "".join("".join(a) + "".join(b) for a, b in path)
            out.append((str(row[0]), digest, subroot, root, h(flat), now, now == root))
    return sorted(out)


def got(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    found = op.lowered(docs)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((str(r[0]), *r[1:]) for r in found.collect())


def test_random_tables(spark):
    rnd = random.Random(5)
    for sources in (3, 40):
        rows = []
        for i in range(600):
            s = None if rnd.random() < 0.01 else f"s{rnd.choice([0, 0, rnd.randrange(sources)])}"
            text = None if i % 17 == 0 else rnd.choice(["", "Ab c", "no capital é", "ÀÉ Zz" * 3])
            rows.append((i * 7 % 600, s, "en", None if i % 5 == 0 else i, text))
        assert got(spark, rows) == expected(rows)


def test_nulls_repeats_and_small_sources(spark):
    rows = [(5, "b", None, 1, "Text")] * 20 + [(None, "b", "en", 2, None)] * 2
    rows += [(5, "b", "en", 3, "other"), (1, "", "en", 0, ""), (2, None, None, None, None)]
    rows += [(3, "Z", "en", 9, "x" * 1_000_000), (4, "\U0001f600", "de", 1, "é"), (4, "￮", "de", 1, "Q")]
    assert got(spark, rows) == expected(rows)


def test_one_row_and_none(spark):
    assert got(spark, []) == []
    rows = [(5, "a", "en", 3, "ABC")]
    assert got(spark, rows) == expected(rows)
    assert got(spark, rows)[0][4] == hashlib.sha256(b"").hexdigest()


def test_proofs_fold_only_what_was_there(spark):
    rows = [(i, f"s{i % 3}", "en", 1, f"Text {i}") for i in range(100)]
    proved = op.prove(spark.createDataFrame(rows, ", ".join(SCHEMA.split(", ")[:5])), fan=4)
    found = proved.select(
        (op.folded(proved.digest, proved.proof) == proved.root).alias("own"),
        (op.folded(proved.subroot, proved.proof) == proved.root).alias("other"),
    ).collect()
    assert len(found) == 100 and all(r.own and not r.other for r in found)
    assert proved.selectExpr("max(size(proof)) as n").first().n == 3 + 1
