import random
import zlib
from hashlib import sha256

import pytest
from inkveil.llm import merkle


def H(s):
    return sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, source, lang, n_chars, text):
    return H("".join(map(field, (doc_id, source, lang, n_chars, text))))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def way(tree, i):
    for level in tree[:-1]:
        run = i // 3 * 3
        yield "".join(level[run:i]), "".join(level[i + 1 : run + 3])
        i //= 3


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = levels([leaf(*r) for r in by[s]])
    upper, out = levels([trees[s][-1][0] for s in sources]), []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            sides = [*way(trees[s], i), *way(upper, k)]
            text = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            node = leaf(*r[:4], text)
            for left, right in sides:
                node = H(left + node + right)
            out.append((r[0], leaf(*r), trees[s][-1][0], upper[-1][0], H("".join(a + b for a, b in sides)), node, node == upper[-1][0]))
    return sorted(out, key=repr)


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, level long, digest string, part long")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for i in range(150):
        source = rng.choice([None, "", "hot", "hot", "hot", "=b", "é", "z" + str(rng.randrange(9))])
        text = rng.choice([None, "", "one\ntwo\n", "no line", "ü\n" * 50, "long " * 20000 + "\n"])
        out.append((rng.randrange(10**6) if i % 30 else None, source, rng.choice([None, "en"]), rng.choice([None, i]), text))
    return out + [out[5]] * 20  # repeated rows


@pytest.mark.parametrize("ranged", [50_000, 13])
def test_all_columns(spark, rows, ranged):
    got = merkle.manifest(merkle.without_newlines(docs(spark, rows)), rows=ranged)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 10])
def test_few_leaves(spark, n):
    rows = [(i, "s", "en", 1, f"a\n{i}") for i in range(n)]
    assert sorted((tuple(r) for r in merkle.tampered(docs(spark, rows)).collect()), key=repr) == brute(rows)


def test_what_is_not_changed_is_verified(spark, rows):
    assert merkle.manifest(docs(spark, rows)).where("NOT verified").count() == 0


def test_forests_merge_in_any_order_and_grouping():
    rng = random.Random(1)
    for total in (1, 2, 3, 4, 9, 10, 28, 100):
        digests = [H(str(i)) for i in range(total)]
        want = {(len(levels(digests)) - 1, 0): levels(digests)[-1][0]}
        cuts = sorted({0, total, *(rng.randrange(total + 1) for _ in range(6))})
        parts = [merkle.folded(digests[a:b], a, total)[0] for a, b in zip(cuts, cuts[1:])]
        rng.shuffle(parts)
        while len(parts) > 1:
            take = [parts.pop(rng.randrange(len(parts))) for _ in range(min(len(parts), rng.randrange(2, 4)))]
            parts.append(merkle.merge({k: v for p in take for k, v in p.items()}, total)[0])
        assert parts[0] == want
        assert merkle.merge(parts[0], total)[0] == want  # neutral: nothing to add


def test_a_range_leaves_few_nodes():
    left, _ = merkle.folded([H(str(i)) for i in range(5000)], 1234, 100_000)
    assert len(left) <= 4 * merkle.top(100_000)
