"""The corpus operators on small tables with every awkward row."""

import datetime
import functools
import hashlib
import math
import re
import tempfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docsift.llm import decontaminate, exact_dedup, license_scan, line_dedup, mixing, pii, sharding, simhash, toxicity, warc
from docsift.llm.common import table

from ..conftest import SF001, SF01

SF1 = "/root/testdata/sf0.1"

LONG_LINE = "this line is long enough to be compared across documents"
LOREM = "one two three four five six seven eight nine ten eleven twelve"
# doc_id, text, source; then columns whose names the operators use themselves.
ROWS = [
    (1, f"{LOREM}\n{LONG_LINE}\nReleased under the MIT License.", "b"),
    (2, f"  {LONG_LINE.upper()}\t\n{LOREM}", "a"),
    (3, None, "a"),
    (4, "", None),
    (4, "", None),
    (5, " \n\t ", "a"),
    (None, f"{LONG_LINE}\nx", "b"),
    (6, LOREM, "b"),
    (7, LOREM.replace(" ", "  "), "b"),
    (7, LOREM.replace(" ", "  "), "b"),
    (8, (LOREM + " ") * 4000 + f"\n{LONG_LINE}", "a"),
    (9, f"{LONG_LINE}\n{LONG_LINE}\nmit cc by nc", "c"),
    (10, f"É\n{LONG_LINE}", "c"),
    (None, None, None),
]
SCHEMA = "doc_id bigint, text string, source string, size string, shard string, slot int, doc int, key string, cell int, fp string, score string, hits int, lines int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "s", "h", 1, 2, "k", 3, "f", "x", 4, 5) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_mixing_against_plain_python(docs, empty):
    out = mixing.mix(docs).select("doc.doc_id", "doc.source", "size", "source_size", "target", "copies").collect()
    assert len(out) == len(ROWS)
    assert sorted(r.size for r in out) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in ROWS)
    total = sum(r.size for r in out)
    sizes = {r.source: r.source_size for r in out}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:  # reshare the excess until no source is above its cap
        rest = 1.5 * total - sum(2 * sizes[s] for s in full)
        targets = {s: rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order if s not in full}
        above = {s for s, t in targets.items() if t > 2 * sizes[s]}
        if not above:
            break
        full |= above
    for r in out:
        assert math.isclose(r.target, 2 * r.source_size if r.source in full else targets[r.source])
        assert 0 <= r.copies <= 2
    again = mixing.mix(docs.repartition(5), cell_digits=1).select("doc.doc_id", "doc.source", "size", "source_size", "target", "copies")
    assert rows(again) == sorted((tuple(r) for r in out), key=repr)
    emitted = mixing.emit(mixing.mix(docs))
    assert emitted.columns == docs.columns and emitted.count() == sum(r.copies for r in out)
    assert mixing.mix(empty).count() == 0


def test_mix_comes_near_its_targets(spark):
    mixed = mixing.mix(table(spark, SF01, "documents"))
    per = mixed.groupBy("doc.source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("got")).collect()
    assert abs(sum(r.got for r in per) / sum(r.t for r in per) - 1) < 0.05
    assert all(abs(r.got - r.t) < 0.35 * r.t for r in per)


def test_shards(docs, empty, spark):
    out = sharding.assign_shards(docs, 3).collect()
    assert len(out) == len(ROWS)
    shard_of = defaultdict(set)
    for r in out:
        shard_of[bytes(r.gid)].add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())
    for s in range(3):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sorted(r.size for r in out) == sorted(len((t or "").encode()) + 8 for _, t, _ in ROWS)
    assert sharding.assign_shards(empty).count() == 0
    sizes = [r.b for r in sharding.assign_shards(table(spark, SF01, "documents")).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) < 0.001 * max(sizes)


def test_groups_of_many_levels_are_balanced(spark):
    """More buckets than packs may meet on the driver: further levels."""
    groups = spark.range(6000).select(
        F.unhex(F.md5(F.col("id").cast("string"))).alias("gid"), (10 + F.pmod(F.xxhash64("id"), F.lit(90))).alias("bytes")
    )
    groups = groups.unionByName(spark.createDataFrame([(b"big", 9000)], "gid binary, bytes bigint"))
    sharding_rows = sharding.shard_groups(groups, 4, 16, 20).join(groups, "gid").collect()
    assert len(sharding_rows) == len({bytes(r.gid) for r in sharding_rows}) == 6001
    sizes = [sum(r.bytes for r in sharding_rows if r.shard == s) for s in range(4)]
    assert max(sizes) - min(sizes) < sum(sizes) / 64  # a pack


def test_written_shards_hold_every_document(docs, spark):
    path = tempfile.mkdtemp(prefix="docsift-shards-")
    narrow = docs.select("doc_id", "text")
    sharding.write_shards(narrow, path, 3)
    back = spark.read.parquet(path)
    assert rows(back.select("doc_id", "text")) == rows(narrow)


def _slow_lines(min_docs):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for d, t, _ in ROWS:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(d)
    low = lambda d: -1 if d is None else d
    out = []
    for d, t, _ in ROWS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= min_docs and d != max(held[key(x)], key=low))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs", [2, 5, 100])
def test_line_dedup_against_plain_python(docs, min_docs):
    out = line_dedup.drop_repeated_lines(docs, min_docs=min_docs)
    assert rows(out.select("doc.doc_id", "n_lines", "n_dropped", "kept")) == _slow_lines(min_docs)


def test_null_ids_are_one_document_in_sql_and_spark(spark):
    """Four ids and two rows without one hold a line: five documents; the largest id keeps it."""
    import duckdb

    from docsift.llm.oracles import LINE_DEDUP

    table = [(i, f"{LONG_LINE}\n{i}") for i in (1, 2, 3, 4, None, None)] + [(9, "other"), (None, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", table)
    expected = sorted(con.sql(LINE_DEDUP).fetchall(), key=repr)
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(table, "doc_id bigint, text string"))
    assert rows(out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))) == expected
    assert sorted((r[0], r[2]) for r in expected if r[0] is not None) == [(1, 1), (2, 1), (3, 1), (4, 0), (9, 0)]


def test_line_dedup_of_nothing(empty):
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_license_scan_against_plain_python(docs, empty, spark):
    templates = license_scan.default_templates()

    def slow(text):
        w = re.findall(license_scan.WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
        base = [(t.label, i) for t in templates if t.phrase for i in range(len(w)) if tuple(w[i : i + len(t.words)]) == t.words]
        blocks = [set(w[k : k + 128]) for k in range(0, max(1, len(w)), 64)]
        shares = [(t.label, max(len(b & set(t.words)) for b in blocks) / len(set(t.words)), t) for t in templates if not t.phrase]
        found = [(label, s) for label, s, t in shares if s * len(set(t.words)) >= t.need]
        at = [i for _, i in base]
        return (
            len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in base})),
            ",".join(sorted({x for x, _ in base + found})), 1.0 if base else max([s for _, s in found], default=0.0),
        )

    notice = license_scan.NOTICES["mpl-2"]
    extra = [
        (20, "word " * 60 + notice + " word" * 70), (21, " ".join(notice.split()[:-4])), (22, " ".join(notice.split()[:18])),
        (23, "Under the MIT-License; apache license, VERSION 2.0 under the mit license"), (24, license_scan.NOTICES["gpl-3"] + "\n" * 3),
    ]
    given = docs.select("doc_id", "text", "score", "hits").unionByName(spark.createDataFrame([(*x, "s", 1) for x in extra], "doc_id bigint, text string, score string, hits int"))
    wanted = sorted(((r.doc_id, *slow(r.text)) for r in given.collect()), key=repr)
    assert rows(license_scan.scan(given)) == wanted
    assert license_scan.scan(empty).count() == 0


def _write_files(docs, parts):
    path = tempfile.mkdtemp(prefix="docsift-dedup-")
    docs.repartition(parts).write.mode("overwrite").parquet(path)
    return path


def _slow_groups():
    groups = defaultdict(list)
    for d, t, _ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    return sorted(((d, min(g)[3], len(g), k) for k, g in groups.items() for *_, d in g), key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_over_several_batches(spark, docs, weak):
    digest = (lambda c: F.substring(F.sha2(c, 256), 1, 1)) if weak else exact_dedup.sha256
    path = _write_files(docs, 3)
    out = exact_dedup.exact_groups(spark, path, digest=digest, max_files_per_trigger=1)
    got = out.select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got if r.doc_id) == sorted(x[:3] for x in _slow_groups() if x[0])
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == len({k for *_, k in _slow_groups()})


def test_exact_dedup_state_goes_on_with_new_files(spark, docs, empty):
    path, state = _write_files(docs, 1), tempfile.mkdtemp(prefix="docsift-state-")
    exact_dedup.stream_state(spark, path, state)
    docs.limit(3).write.mode("append").parquet(path)
    counts = exact_dedup.stream_state(spark, path, state).agg(F.sum("n")).first()[0]
    assert counts == len(ROWS) + 3
    assert exact_dedup.exact_groups(spark, _write_files(empty, 1)).count() == 0


def test_simhash_against_plain_python(docs, empty):
    out = simhash.near_duplicates(docs, max_group=3).collect()  # keys of more than three nodes are cut
    fp = lambda t: simhash.fingerprint(t or "")
    assert sorted(r.fp & (2**64 - 1) for r in out) == sorted(fp(t) for _, t, _ in ROWS)
    fps = sorted({fp(t) for _, t, _ in ROWS})
    root = {x: x for x in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    first = defaultdict(list)
    for d, t, _ in ROWS:
        first[root[fp(t)]].append(d)
    wanted = [(d, min((x for x in first[root[fp(t)]] if x is not None), default=None)) for d, t, _ in ROWS]
    assert sorted(((r.doc_id, r.component_id) for r in out), key=repr) == sorted(wanted, key=repr)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(first)
    assert simhash.near_duplicates(empty).count() == 0


def test_star_components_of_a_long_chain(spark):
    edges = spark.range(1, 300).selectExpr("id as a", "id - 1 as b").union(spark.sql("select 500L a, 499L b"))
    got = {r.node: r.root for r in simhash.star_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 300)}, 500: 499}


def test_toxicity_is_learned_on_held_out_documents(spark):
    documents, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    model = toxicity.fit_toxicity(documents, labels)
    held = documents.where(toxicity.fold(F.col("doc_id")) == 0).join(labels, "doc_id")
    got = held.select("toxic", toxicity.score_column(F.col("text"), model).alias("score")).collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in got)
    assert len(got) > 50 and right / len(got) >= 0.95
    pairs = [(a.score, b.score) for a in got for b in got if a.toxic == 1 and b.toxic == 0]
    assert sum(a > b for a, b in pairs) / len(pairs) >= 0.97


def test_toxicity_recall_and_false_alarms_of_the_held_out_fold(spark):
    documents, labels = table(spark, SF1, "documents"), table(spark, SF1, "labels")
    model = toxicity.fit_toxicity(documents, labels)
    held = documents.where(toxicity.fold(F.col("doc_id")) == 0).join(labels, "doc_id")
    got = held.select("toxic", toxicity.score_column(F.col("text"), model).alias("score")).collect()
    toxic, clean = ([r.score >= 0.5 for r in got if r.toxic == k] for k in (1, 0))
    assert len(toxic) == 97 and sum(toxic) >= 80  # 62 at the cut of an unweighted fit
    assert len(clean) == 728 and sum(clean) <= 7


def test_toxic_passages_in_long_clean_texts(spark):
    documents, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    model = toxicity.fit_toxicity(documents, labels)
    score = lambda texts: [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(toxicity.score_column(F.col("text"), model)).collect()]
    held = documents.where(toxicity.fold(F.col("doc_id")) == 0).join(labels, "doc_id").orderBy("doc_id").select("text", "toxic").collect()
    toxic = [r.text for r in held if r.toxic == 1]
    toxic = [t for t, s in zip(toxic, score(toxic)) if s >= 0.5]
    clean = [r.text for r in held if r.toxic == 0 and len(r.text) < 8000]
    around = [[clean[(7 * k + 3 * i) % len(clean)] for i in range(20)] for k in range(10)]  # 20 clean texts each
    planted = ["\n".join([*a[:k], toxic[k % len(toxic)], *a[k:]]) for k, a in enumerate(around)]
    assert len(toxic) >= 3 and min(map(len, planted)) > 10 * toxicity.WINDOW
    assert sum(s >= 0.5 for s in score(planted)) >= 9
    assert sum(s >= 0.5 for s in score("\n".join(a) for a in around)) <= 1


def test_toxicity_of_awkward_tables(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, none)
    assert [r[0] for r in docs.select(toxicity.score_column(F.col("text"), model)).collect()] == [0.0] * len(ROWS)
    some = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, None), (None, 1), (99, 1), (6, 0), (7, 1), (8, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(toxicity.labelled_sample(docs, some))
    scored = docs.select(toxicity.score_column(F.col("text"), model).alias("p"))
    assert all(0 <= r.p <= 1 for r in scored.collect()) and scored.count() == len(ROWS)
    assert empty.select(toxicity.score_column(F.col("text"), model)).count() == 0


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, LOREM), (2, None), (3, LOREM), (4, "short one"), (None, "words that no document has at all here")], "item_id bigint, text string")
    found = docs.select("doc_id", decontaminate.benchmark_hits(docs, bench).alias("h")).collect()
    wanted = [d for d, t, _ in ROWS if "one two" in " ".join((t or "").split())]
    assert sorted(r.doc_id for r in found if r.h) == sorted(wanted)
    assert all({x.item_id for x in r.h} == {1, 3} for r in found if r.h)
    blocks = docs.select("doc_id", decontaminate.benchmark_hits(docs, bench, max_items=1).alias("h")).collect()
    assert sorted((str(r.doc_id), sorted(x.item_id for x in r.h)) for r in blocks) == sorted((str(r.doc_id), sorted(x.item_id for x in r.h)) for r in found)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - len(wanted)
    assert decontaminate.clean(docs, bench.where("false")).count() == len(ROWS)
    assert decontaminate.clean(empty, bench).count() == 0


PRIVATE = [
    (1, "call +1 (988) 555-2485 or 4944339490429605, ip 29.217.126.147. born 1987-02-28; 31.12.2001 02/30/2000 02/29/2000"),
    (2, "ssn 123-45-6789 and 666-45-6789 card 4111 1111 1111 1111 4111111111111111 bad 4111111111111112"),
    (3, "DE89370400440532013000 GB82WEST12345698765432 DE89370400440532013001 bosbt.42@mail8.example.com"),
    (4, None), (5, ""), (6, "1987-02-28 twice 1987-02-28, 300.1.1.1 v2.0 " + "x" * 100_000), (6, "again 4111111111111111"),
]


def test_pseudonyms_round_trip_and_stay_linked(spark):
    given = spark.createDataFrame([(*r, "c") for r in PRIVATE], "doc_id int, text string, kinds string")
    out = pii.pseudonymise(given, "k")
    got = {(r.doc_id, r.text) for r in out.select("doc.doc_id", "text").collect()}
    back = pii.pseudonymise(out.select("doc.*", "text"), "k", inverse=True)
    assert rows(back.select("doc.doc_id", "text", "doc.kinds")) == rows(given)
    texts = {d: t for d, t in got if d != 6}
    assert texts[4] is None and texts[5] == ""
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10
    card = re.search(r"or (\d{16}),", texts[1]).group(1)
    assert luhn(card) == 0 and card != "4944339490429605" and "02/30/2000" in texts[1] and "987" not in texts[1]
    spaced, plain = re.search(r"card (\d{4} \d{4} \d{4} \d{4}) (\d{16}) bad 4111111111111112", texts[2]).groups()
    assert spaced.replace(" ", "") == plain and any(t and t == f"again {plain}" for _, t in got)
    assert "666-45-6789" in texts[2] and "DE89370400440532013001" in texts[3] and "@mail8.example.com" in texts[3]
    other = pii.pseudonymise(given, "another").where("doc.doc_id = 1").first().text
    assert other != texts[1]
    assert [r.n_found for r in out.orderBy("doc.doc_id").collect()][:3] == [6, 3, 3]
    assert pii.pseudonymise(given.where("false"), "k").count() == 0


def test_phones_of_any_area_are_replaced_and_stay_reversible(spark):
    areas = ["000", "017", "199", "200", "201", "555", "988", "999"]
    phones = [f"+1 ({a}) {e}-7713" for a in areas for e in areas] + [f"+1-{a}-{e}-0000" for a in areas for e in areas]
    given = spark.createDataFrame([(i, p) for i, p in enumerate(phones)], "doc_id int, text string")
    out = pii.pseudonymise(given, "k").select("doc.doc_id", "text", "n_found", "kinds").orderBy("doc_id").collect()
    assert all(r.n_found == 1 and r.kinds == "phone" and r.text != p for r, p in zip(out, phones))
    assert all(re.sub(r"\d", "0", r.text[2:]) == re.sub(r"\d", "0", p[2:]) for r, p in zip(out, phones))
    assert len({r.text for r in out}) == len(phones)
    back = pii.pseudonymise(spark.createDataFrame([(r.doc_id, r.text) for r in out], "doc_id int, text string"), "k", inverse=True)
    assert [r.text for r in back.select("doc.doc_id", "text").orderBy("doc_id").collect()] == phones


def plain_pseudonym(kind, m, key="k"):
    """The pseudonym of a valid value, in plain Python."""

    def permute(left, right, a, b):
        for n in range(pii.ROUNDS):
            other, size = (right, a) if n % 2 == 0 else (left, b)
            shift = int(hashlib.sha256(f"{key}|{kind}|{a}x{b}|{n}|{other}".encode()).hexdigest()[:15], 16) % size
            left, right = ((left + shift) % a, right) if n % 2 == 0 else (left, (right + shift) % b)
        return left, right

    def digits_of(text):
        n, half = len(text), len(text) // 2
        left, right = permute(int(text[:half]), int(text[half:]), 10**half, 10 ** (n - half))
        return f"{left:0{half}}{right:0{n - half}}"

    def refill(shape, new):
        new = iter(new)
        return "".join(next(new) if c.isdigit() else c for c in shape)

    digits = re.sub(r"\D", "", m)
    if kind == "ip":
        o = [int(x) for x in m.split(".")]
        left, right = permute(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if kind == "card":
        body = digits[0] + digits_of(digits[1:-1])
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(body + "0")))
        return refill(m, body + str(-luhn % 10))
    if kind == "ssn":
        area, group, serial = int(m[:3]), int(m[4:6]), int(m[7:])
        left, right = permute(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        return f"{left + 1 + (left >= 665):03}-{right // 9999 + 1:02}-{right % 9999 + 1:04}"
    if kind == "date":
        form = "%Y-%m-%d" if "-" in m else "%d.%m.%Y" if "." in m else "%m/%d/%Y"
        first = datetime.date(1900, 1, 1)
        days = (datetime.datetime.strptime(m, form).date() - first).days
        left, right = permute(*divmod(days, 4297), 17, 4297)
        return (first + datetime.timedelta(left * 4297 + right)).strftime(form)
    if kind == "phone":
        pairs = [(x, y) for x in range(1000) for y in range(1000)]
        usual = sorted(p for p in pairs if p[0] >= 200 and p[1] >= 200)
        other = sorted(p for p in pairs if p[0] < 200) + sorted(p for p in pairs if p[0] >= 200 and p[1] < 200)
        own = (int(digits[-10:-7]), int(digits[-7:-4]))
        table = usual if own in set(usual) else other
        left, right = permute(table.index(own), int(digits[-4:]), len(table), 10_000)
        return refill(m, digits[:-10] + f"{table[left][0]:03}{table[left][1]:03}{right:04}")
    if kind == "iban":
        rest = refill(m[4:], digits_of(re.sub(r"\D", "", m[4:])))
        number = "".join(str(int(c, 36)) for c in rest.replace(" ", "") + m[:2] + "00")
        return f"{m[:2]}{98 - int(number) % 97:02}{rest}"
    local, domain = m.split("@")
    symbols, out = re.sub(r"[^A-Za-z0-9]", "", local), ""
    for at in range(0, len(symbols), pii.SYMBOLS_PER_STEP):
        part = symbols[at : at + pii.SYMBOLS_PER_STEP]
        halves = part[: len(part) // 2], part[len(part) // 2 :]
        radix = lambda c: 10 if c.isdigit() else 26
        zero = lambda c: "0" if c.isdigit() else "A" if c.isupper() else "a"
        values = [functools.reduce(lambda v, c: v * radix(c) + ord(c) - ord(zero(c)), h, 0) for h in halves]
        moved = permute(*values, *[math.prod(map(radix, h)) for h in halves])
        for h, v in zip(halves, moved):
            text = ""
            for c in reversed(h):
                v, x = divmod(v, radix(c))
                text = chr(ord(zero(c)) + x) + text
            out += text
    new = iter(out)
    return "".join(next(new) if c.isascii() and c.isalnum() else c for c in local) + "@" + domain


#: Values by kind, in every notation.
NOTATIONS = [
    ("ip", "10.20.30.40"), ("card", "4111111111111111"), ("card", "4111 1111 1111 1111"), ("card", "3782-822463-10005"),
    ("card", "3782 822463 10005"), ("ssn", "123-45-6789"), ("ssn", "667-01-0001"), ("date", "2020-01-31"), ("date", "29.02.2000"),
    ("date", "12/31/1999"), ("phone", "+1 (988) 555-2485"), ("phone", "+1-017-555-7713"), ("phone", "+1 212 555 0134"),
    ("phone", "(212) 555-0134"), ("phone", "212-555-0134"), ("phone", "1.212.055.0134"), ("iban", "DE89370400440532013000"),
    ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"), ("iban", "GB82 WEST 1234 5698 7654 32"),
    ("email", "bosbt.42@mail8.example.com"), ("email", "A_very-long.local+part0123456789" + "x" * 30 + "@x.org"),
]


def test_pseudonyms_follow_the_feistel_rounds(spark):
    given = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(NOTATIONS)], "doc_id int, text string")
    got = {r.doc_id: (r.kinds, r.text) for r in pii.pseudonymise(given, "k").select("doc.doc_id", "kinds", "text").collect()}
    assert got == {i: (kind, plain_pseudonym(kind, v)) for i, (kind, v) in enumerate(NOTATIONS)}
    new = spark.createDataFrame([(i, t) for i, (_, t) in got.items()], "doc_id int, text string")
    back = pii.pseudonymise(new, "k", inverse=True).select("doc.doc_id", "text").collect()
    assert {r.doc_id: r.text for r in back} == {i: v for i, (_, v) in enumerate(NOTATIONS)}


@pytest.mark.parametrize("around", ["{}", "at {}.", "id_{}_x", "({})", "ref-{} and", "...{}, then", "{}\n{}", "=\"{}\""])
def test_values_are_found_beside_marks(spark, around):
    values = [v for kind, v in NOTATIONS if kind != "email"]
    texts = [around.replace("{}", v) for v in values] + ["2020-01-31T10:00:00Z", "A2020-01-31", "1123-45-67890", "1.10.20.30.40.1"]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows_ = sorted((r.doc_id, r.n_found, r.text) for r in pii.pseudonymise(given, "k").select("doc.doc_id", "n_found", "text").collect())
    assert [n for _, n, _ in rows_] == [around.count("{}")] * len(values) + [1, 0, 0, 0]
    for (i, _, text), value in zip(rows_, values):
        assert value not in text and text.startswith(around.split("{}")[0])
    assert rows_[len(values)][2].endswith("T10:00:00Z") and not rows_[len(values)][2].startswith("2020-01-31")


def test_the_parts_of_a_value_are_evaluated_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    plan = pii.pseudonymise(spark.createDataFrame([(1, "x")], "doc_id int, text string"), "k")._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    # One each for card, phone and iban (tested and used: two), and email (tested, counted, cut); no round repeats them.
    assert plan.count("regexp_replace(") <= 8


def test_the_key_is_in_no_plan(spark):
    given = spark.createDataFrame([(1, "10.20.30.40")], "doc_id int, text string")
    out = pii.pseudonymise(given, "a-very-secret-key")
    assert out.first().text == plain_pseudonym("ip", "10.20.30.40", "a-very-secret-key")
    plans = out._jdf.queryExecution()
    assert "a-very-secret-key" not in plans.toString() + plans.stringWithStats() + plans.logical().toJSON()
    assert pii.pseudonymise(given).first().text != pii.pseudonymise(given).first().text  # no key: a random one
    spark.conf.set(pii.KEY_SETTING, "k")
    assert pii.pseudonymise(given).first().text == plain_pseudonym("ip", "10.20.30.40")
    spark.conf.unset(pii.KEY_SETTING)


def test_archives_round_trip(spark):
    html = ["<p>é</p>", "", None, "<p>é</p>", "WARC/1.1\r\nContent-Length: 5\r\n\r\nx\r\n\r\n", "y" * 300_000, "<p>é</p>", ""]
    ids = [5, 2, 9, 3, 4, 6, None, 2]
    pages = spark.createDataFrame([(i, "http://x/a b\n" if i else None, h, "r") for i, h in zip(ids, html)], "page_id bigint, url string, html string, size string")
    root = tempfile.mkdtemp(prefix="docsift-warc-")
    warc.write_monolithic(warc.plan_records(pages.repartition(2)), f"{root}/whole", records_per_file=3)
    index = warc.normalise(spark, f"file://{root}/whole", f"file://{root}/members")
    out = warc.read_records(index, with_payload=True).collect()
    assert len(out) == len(ids)
    by_id = {(r.page_id, r.record_type, r.refers_to): r for r in out}
    assert set(by_id) == {("5", "revisit", "3"), ("2", "response", None), ("9", "revisit", "2"), ("3", "response", None), ("4", "response", None), ("6", "response", None), (None, "revisit", "3")}
    assert by_id["3", "response", None].payload.decode() == "<p>é</p>" and by_id["4", "response", None].payload.decode() == html[4]
    assert by_id["5", "revisit", "3"].payload_bytes == len("<p>é</p>".encode())
    empty = warc.plan_records(pages.where("false"))
    warc.write_monolithic(empty, f"{root}/none")
    assert warc.read_records(warc.normalise(spark, f"file://{root}/none", f"file://{root}/none-members")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = table(spark, SF001, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, docs, SF001), "test")
        assert after.columns == docs.columns, name
        if name != "mix":
            assert after.exceptAll(docs).isEmpty() and 0 < after.count() <= docs.count()
        docs = after
    out = corpus_pipeline.run(spark, SF001)
    assert out.count() == docs.count()
    assert rows(out.groupBy("doc_id").count()) == rows(docs.groupBy("doc_id").count())


def test_pipeline_stages_on_awkward_rows(spark, docs, empty):
    """Nulls, empty and repeated rows, a long text and clashing columns through
    each stage: what its operator decides takes effect, and nothing else."""
    import corpus_pipeline
    from docsift.llm.common import materialize

    stages = dict(corpus_pipeline.STAGES)
    done = materialize(stages["toxicity"](spark, docs, SF001), "test")
    model = toxicity.fit_toxicity(docs, table(spark, SF001, "labels"))
    clean = docs.withColumn("p", toxicity.score_column(F.col("text"), model)).where("p < 0.5").drop("p")
    assert rows(done) == rows(clean)
    # one row of each component; fingerprints and components in plain Python
    before = [(r.doc_id, r.text) for r in done.collect()]
    fps = [simhash.fingerprint(t or "", simhash.SHINGLE) for _, t in before]
    left, components = set(range(len(before))), 0
    while left:
        todo = [left.pop()]
        components += 1
        while todo:
            x = todo.pop()
            near = {y for y in left if bin(fps[x] ^ fps[y]).count("1") <= simhash.RADIUS}
            left -= near
            todo += near
    done = materialize(stages["near_dedup"](spark, done, SF001), "test")
    assert done.count() == components and done.exceptAll(docs).isEmpty()
    hits = decontaminate.benchmark_hits(done, table(spark, SF001, "benchmark"))
    without = done.where(F.size(hits) == 0)
    done = materialize(stages["decontaminate"](spark, done, SF001), "test")
    assert rows(done) == rows(without)
    copies = mixing.mix(done).select("doc.*", "copies")
    expected = sorted((tuple(r)[:-1] for r in copies.collect() for _ in range(r.copies)), key=repr)
    done = materialize(stages["mix"](spark, done, SF001), "test")
    assert rows(done) == expected
    placed = stages["shard"](spark, done, SF001).collect()
    assert sorted((repr(r.doc_id), r.size) for r in placed) == sorted((repr(r.doc_id), len((r.text or "").encode()) + 8) for r in done.collect())
    slots = defaultdict(list)
    for r in placed:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF001).count() == 0, name


def test_queries_match_their_sql(spark):
    import duckdb

    from docsift.llm import oracles, queries
    from tools.compare import digest

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    for name, sql in oracles.ORACLES.items():
        got, want = queries.QUERIES[name](spark, SF001), con.sql(sql)
        columns, found = want.columns, want.fetchall()
        assert sorted(got.columns) == sorted(columns)
        assert digest(got.columns, [tuple(r) for r in got.collect()])[0] == digest(columns, found)[0], name
