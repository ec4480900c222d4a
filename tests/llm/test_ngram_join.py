import itertools
import random

import pytest

from graphloom.llm import ngram_join, queries
from graphloom.llm.ngram_join import _pack, _unpack, keep_one, near_duplicates, shingle_set

from ..conftest import same_rows


def sets_of(rows, n=5):
    out = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        out.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set()))
    return out


def brute(rows, percent=75, n=5):
    sets = sets_of(rows, n)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    return sorted(((i, len(sets[k]), min((x for x in members[find(k)] if x is not None), default=None) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int").repartition(3)
    return sorted(map(tuple, near_duplicates(df, **more).collect()), key=repr)


def corpus(seed, size=90):
    """Random texts, chains of edited copies, exact copies, and a passage that many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ä", "ß", "the", "of"]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    texts = []
    while len(texts) < size:
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                words = words[: max(1, len(words) - rng.randint(0, 8))]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 9, 30, 60]))]
            if rng.random() < 0.5:
                words += passage
        texts.append(" ".join(words).upper() if rng.random() < 0.1 else " ".join(words))
    return list(enumerate(texts, start=100))


@pytest.mark.parametrize(("seed", "cluster_size"), [(1, 20_000), (2, 0), (3, 20_000)])
def test_brute_force(spark, seed, cluster_size):
    rows = corpus(seed)
    assert run(spark, rows, cluster_size=cluster_size) == brute(rows)


def test_hot_groups(spark):
    """Hundreds of near copies of one text, many of them no link of each other."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base)) for i in range(200)]
    assert run(spark, rows) == brute(rows)


def test_edge_cases(spark):
    long_text = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One  TWO\n"), (6, "one"), (None, "one two"), (None, "q r s t u v"), (7, long_text), (8, long_text + " end"), (9, "a b c d e"), (9, "a b c d e"), (9, "other words that are not the same")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 50)
    rows = corpus(4, 40)
    assert run(spark, rows, bucket_bytes=200) == brute(rows)
    assert run(spark, rows, bucket_bytes=200, max_partitions=3) == brute(rows)


def test_orders_leave_fewer_pairs(spark):
    """What each order's prefix filter lets through, and all three: every link, and fewer other pairs with each."""
    import numpy as np

    rng = random.Random(9)
    common, vocabulary = [f"c{i}" for i in range(30)], [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(120):
        at = rng.randrange(20)
        texts.append(" ".join([rng.choice(vocabulary) for _ in range(rng.randint(25, 60))] + common[at : at + 10]))
    texts += [t + f" end{k}" for k, t in enumerate(texts[:30])]
    sets = [shingle_set(t) for t in texts]
    count = {}
    for s in sets:
        for x in s.tolist():
            count[x] = count.get(x, 0) + 1
    prefixes = []
    for s in sets:
        shared = np.array([x for x in s.tolist() if count[x] > 1], dtype=np.uint64)
        size = max(0, len(shared) - ngram_join.need(len(s), 75) + 1)
        levels = np.array([int(np.log2(count[x]) * 8) for x in shared.tolist()], dtype=np.uint8)
        first, second, third = ngram_join.orders(shared, levels, size)
        prefixes.append([set(first[:size].tolist()), set(second.tolist()), set(third.tolist())])
    pairs = list(itertools.combinations(range(len(sets)), 2))
    linked = {(a, b) for a, b in pairs if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    through = [{(a, b) for a, b in pairs if prefixes[a][k] & prefixes[b][k]} for k in range(3)]
    assert len(linked) >= 25 and all(linked <= t for t in through)
    every = through[0] & through[1] & through[2]
    assert linked <= every and len(every) < len(through[0] & through[1]) <= min(map(len, through)) or len(through[0]) == len(linked)


def test_keep_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "", "z"), (4, None, "z"), (None, "p q r", "n"), (5, "k", "s"), (5, "k", "s")], "doc_id long, text string, source string")
    got = keep_one(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "a b c d e f", "x"), (3, "", "z"), (4, None, "z"), (None, "p q r", "n"), (5, "k", "s")], key=repr)


def test_packing():
    import numpy as np

    for values in ([5], [0, 1, 2**55], sorted(random.Random(1).sample(range(2**56), 1000))):
        x = np.array(values, dtype=np.uint64)
        assert (_unpack(*_pack(x)) == x).all()
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("a")) == 1


def test_one_large_component(spark):
    """A third of the rows in one group of exact copies, another in a chain of near copies: hot keys in every join."""
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(700)]
    for i in range(700):
        at = i // 2
        rows.append((1000 + i, " ".join(f"k{at + j}" for j in range(100))))
    rows += [(5000 + i, " ".join(f"u{i}v{j}" for j in range(12))) for i in range(700)]
    got = run(spark, rows)
    want = {i: 0 for i in range(700)} | {1000 + i: 1000 for i in range(700)} | {5000 + i: 5000 + i for i in range(700)}
    assert {i: c for i, _, c in got} == want and len(got) == len(rows)


def test_sql(spark, sf_dir, duck):
    same_rows(queries.op2_ngram_join(spark, sf_dir), duck, queries.OP2_SQL)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op2_ngram_join(spark, sf_dir).collect()), key=repr) == brute(rows)
