import hashlib
import itertools

import duckdb
from pyspark.sql import functions as F

from tests.llm.conftest import ODD_TEXTS, prose
from tidewell.llm import near_dup


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(rows, percent=75):
    """By brute force: the smallest id reachable from each row's place."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            groups[find(i)] = min(groups.get(find(i), doc_id), doc_id)
    return [(d, len(s), groups.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("_key", F.lit(1))
    got = near_dup.near_duplicates(df, **more).collect()
    want = components(rows)
    assert sorted(map(tuple, [r[:3] for r in got]), key=repr) == sorted(want, key=repr)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def edited(rnd, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
    return " ".join(words)


def test_brute_force(spark, rnd, monkeypatch):
    monkeypatch.setattr(near_dup, "FEW", 2)
    texts = list(ODD_TEXTS)
    hub = prose(rnd, 150)
    texts += [edited(rnd, hub, rnd.randrange(1, 9)) for _ in range(60)]
    for _ in range(25):
        base = prose(rnd, rnd.randrange(3, 120))
        texts += [base, base.upper(), *(edited(rnd, base, rnd.randrange(0, 4)) for _ in range(rnd.randrange(3)))]
    rnd.shuffle(texts)
    rows = [(rnd.randrange(10**9), t) for t in texts] + [(None, hub), (None, "alone in the whole wide world"), (5, "twice"), (5, "twice")]
    check(spark, rows)


def test_empty_table(spark):
    check(spark, [])
    check(spark, [(1, None), (2, ""), (3, None)])


def test_leftover_blocks(spark, rnd, monkeypatch):
    """Nodes that never get small are compared in blocks, whole."""
    monkeypatch.setattr(near_dup, "FEW", 0)
    monkeypatch.setattr(near_dup, "MOST_DEPTH", 1)
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    base = prose(rnd, 100)
    check(spark, [(i, edited(rnd, base, rnd.randrange(2, 8))) for i in range(40)])


def counted(monkeypatch, *names):
    """Rows of the functions' results, as they come."""
    counts = dict.fromkeys(names, 0)
    for name in names:

        def spy(*given, name=name, real=getattr(near_dup, name)):
            out = real(*given)
            counts[name] += out.count()
            return out

        monkeypatch.setattr(near_dup, name, spy)
    return counts


def test_rows_follow_the_size_of_a_group(spark, rnd, monkeypatch):
    """A group of near copies, and one that only shares a passage: neither lists its pairs."""
    counts = counted(monkeypatch, "_small_pairs", "_star_pairs", "_branched")
    base, passage = prose(rnd, 150), prose(rnd, 40)
    made = []
    for n in (60, 240):
        counts |= dict.fromkeys(counts, 0)
        texts = [edited(rnd, base, rnd.randrange(1, 3)) for _ in range(n)] + [f"{prose(rnd, 60)} {passage} {prose(rnd, 60)}" for _ in range(n)]
        check(spark, list(enumerate(texts)))
        made.append(dict(counts))
    assert made[1]["_small_pairs"] + made[1]["_star_pairs"] <= 20 * 480
    assert made[1]["_branched"] <= 12 * 480


def near_pair(rnd, i):
    """Two texts whose sets have 0.75 to 0.77 in common."""
    words = [f"w{i}x{k}" for k in range(204)]
    other = words[:]
    for k in rnd.sample(range(5, 199, 7), 5 if i % 2 else 6):
        other[k] = f"o{i}x{k}"
    return " ".join(words), " ".join(other)


def test_recall_at_the_threshold(spark, rnd):
    """Links of the trees alone, against brute force."""
    pairs = [near_pair(rnd, i) for i in range(400)]
    wanted = set()
    for i, (x, y) in enumerate(pairs):
        common = len(shingles(x) & shingles(y))
        ratio = common / (len(shingles(x)) + len(shingles(y)) - common)
        if ratio >= 0.75:
            assert ratio < 0.8
            wanted.add(i)
    assert len(wanted) > 150
    rows = [(2 * i + k, t) for i, pair in enumerate(pairs) for k, t in enumerate(pair)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id % 2 = 1 and component_id = doc_id - 1").collect()
    found = {r["doc_id"] // 2 for r in got}
    assert found <= wanted and len(found) >= 0.99 * len(wanted)


def test_one_tree_finds_a_share_of_them(spark, rnd, monkeypatch):
    """What trees_for() counts on: one tree meets 0.75 ** 2 of the pairs at the threshold or more."""
    monkeypatch.setattr(near_dup, "trees_for", lambda percent: 1)
    rows = [(2 * i + k, t) for i in range(1, 800, 2) for k, t in enumerate(near_pair(rnd, i))]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id % 2 = 1 and component_id = doc_id - 1").count()
    assert 0.48 * 400 <= got <= 0.72 * 400


def test_very_long_text(spark, rnd):
    long = prose(rnd, 40_000)
    check(spark, [(1, long), (2, long + " more"), (3, "x" * 300_000), (4, "x" * 300_000 + " y"), (5, long[: len(long) // 2])])


def test_components_of_a_path(spark):
    name = [hashlib.md5(str(i).encode()).digest() for i in range(600)]
    links = spark.createDataFrame([(name[i], name[i + 1]) for i in range(200)] + [(name[501], name[500])], "a binary, b binary")
    roots = {bytes(r["node"]): bytes(r["root"]) for r in near_dup.connected(links).collect()}
    assert len(roots) == 203 and len({roots[name[i]] for i in range(201)}) == 1 and roots[name[500]] == roots[name[501]] != roots[name[0]]


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = database.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({near_dup.OP1_SQL})").fetchall()
    got = near_dup.op1_near_dup(spark, sf).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)
