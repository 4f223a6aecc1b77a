import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import decontaminate, graph_search, html_text, jaccard_join, line_crf, line_dedup, mixing, personal_data, sharding, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int"
WORDS = [f"w{i}" for i in range(400)]


def text_of(a, n):
    return " ".join(WORDS[(a * 37 + i * (a + 3)) % 400] for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = text_of(1, 60)
    rows = [(1, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, text_of(5, 60)), (7, "short one"), (8, "short one"), (8, "short one"), (9, "x" * 300_000), (None, base), (10, "a" * 250)]
    return spark.createDataFrame([(i, t, "en", "s" if i and i % 2 else None, 0, 1.0, 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_jaccard(docs, empty):
    got = {r["doc_id"]: r for r in jaccard_join.near_duplicates(docs).collect()}
    assert [got[i]["component_id"] for i in range(1, 11)] == [1, 1, 1, 4, 5, 6, 7, 7, 9, 10]
    assert got[4]["n_shingles"] == got[5]["n_shingles"] == 0 and got[7]["n_shingles"] == 1
    assert jaccard_join.near_duplicates(empty).count() == 0
    assert sorted(r["doc_id"] for r in jaccard_join.keep_one_of_each(docs).where("doc_id is not null").collect()) == [1, 4, 5, 6, 7, 9, 10]


def test_suffix(docs, empty):
    seen, want = set(), {}
    for i, t in sorted({(r["doc_id"], r["text"] or "") for r in docs.where("doc_id is not null").collect()}):
        raw, gone = t.encode(), set()
        for s in range(len(raw) - 99):
            if (w := raw[s : s + 100]) in seen:
                gone.update(range(s, s + 100))
            seen.add(w)
        want[i] = bytes(c for k, c in enumerate(raw) if k not in gone)
    for r in suffix_dedup.remove_repeats(docs).where("doc_id is not null").collect():
        assert bytes(r["kept"]) == want[r["doc_id"]] and r["n_removed"] == r["n_bytes"] - len(want[r["doc_id"]])
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_sort():
    raw = [b"banana bandana " * 8, b"ananas " * 20]
    b = suffix_dedup.Buffer(raw)
    starts = b.window_starts(30)
    buf = b.buf.tobytes()
    assert b.sort(starts, 30).tolist() == sorted(starts.tolist(), key=lambda s: (buf[s : s + 30], s))


def test_lines(spark, empty):
    line = "This line is long enough to count"
    rows = spark.createDataFrame([(1, line + "\nown"), (2, " " + line.upper() + "\t\n" + line), (3, line), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.apply_bitmaps(rows, line_dedup.line_bitmaps(rows)).collect()}
    assert [(got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_text"]) for i in (1, 2, 3, 4, 5)] == [(2, 1, "own"), (2, 2, ""), (1, 0, line), (1, 0, ""), (1, 0, "")]
    assert line_dedup.apply_bitmaps(empty, line_dedup.line_bitmaps(empty)).count() == 0


def test_sharding(docs, empty):
    rows = sharding.assign_shards(docs, 5).collect()
    for s in range(5):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 5) for r in rows)
    assert all(r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) for r in rows)
    assert sharding.assign_shards(empty, 5).count() == 0
    n = np.bincount(sharding.jump_hash(np.arange(100_000), 10))
    assert n.min() > 9_500


def test_html():
    page = "<html><body><nav><a href='/'>Menu</a></nav><div class='content post-12'><h1>T &amp; U</h1><p>One <b>bo</b>ld<br>line<p>Two</div><div class=comments><p>Nice post</p></div><footer>f</footer>"
    assert html_text.main_text(page, None) == "T & U One bold line Two"
    assert html_text.main_text("", None) == "" and html_text.main_text("<p>a<p>b", None) == "a b"


def test_html_table(spark):
    rows = spark.createDataFrame([(1, "http://h.x/1", "<article><p>Hello there</p></article>", "clash"), (2, None, None, "c"), (3, "bad", "", "c")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(rows).collect()}
    assert got == {1: "Hello there", 2: "", 3: ""}


def test_html_whole_article(spark):
    long = lambda k: " ".join(f"{k}word{i}" for i in range(120))
    menu = "<nav><a href='/'>Menu</a></nav>"
    shapes = {
        "a": lambda k: f"{menu}<article><h1>Title {k}</h1><p>lead {k}</p><div class=entry-content><p>{long(k)}</p></div></article><footer>f</footer>",
        "b": lambda k: f"{menu}<main><div class=lead>Title {k} lead {k}</div><div class=story>{long(k)}</div></main>",
        "c": lambda k: f"{menu}<div class=content><div class=top>Title {k} lead {k}</div><div class=story>{long(k)}</div></div>",
        "d": lambda k: f"<h1>Title {k}</h1><div class=slogan>same on all</div><div class=teaser>lead {k}</div><div class=story>{long(k)}</div><div class=links><a href=x>{k} and more links</a></div>",
    }
    data = [(f"{h}{k}", f"http://{h}.x/{k}", f"<html><body>{f(k)}</body></html>") for h, f in shapes.items() for k in range(4)]
    rows = spark.createDataFrame(data, "page_id string, url string, html string")
    for r in html_text.extract_main_text(rows).collect():
        k = r["page_id"][1]
        assert r["text"] == f"Title {k} lead {k} {long(k)}", r["page_id"]


def test_decontaminate(spark, docs, empty):
    bench = spark.createDataFrame([(1, "If Tom buys 12 apples and then gives 5 apples to his friend how many apples does he keep"), (2, None), (3, "")], "item_id long, text string")
    rows = spark.createDataFrame([(1, "intro text here If Anna buys 40 apples and then gives 7 apples to his friend how many apples does he keep the end"), (2, "nothing of the kind"), (3, None)], "doc_id long, text string")
    got = decontaminate.contaminated(rows, bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 1)] and got[0]["n_changed"] > 0
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench).count() == docs.count()


def test_decontaminate_short_edited_and_numeric(spark):
    long = "a farmer sells {} boxes of ripe fruit at the market and {} counts every coin before going back home by the old river road"
    items = ["the quick fox jumps over lazy dogs", "two plus two is four", "Convert 12 km to 3 miles", "yes no", long.format("12", "Tom"), "Anna 12 Bob 15 Carl 17",
             "red stones fall over quiet water near green hills while cold winds carry dry leaves beyond broken walls"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    pads = [f"{'pad ' * k}{items[0]} end" for k in range(7)]
    texts = pads + ["so two plus two is four then", "please convert 15 km to 7 miles now", "say yes no maybe", "say yes maybe no", f"x {long.format('1 200', 'Mary Ann')} y", "in Anna 12 Bob 15 Carl 17 out",
                    "in Anna 12 Bob 15 Carl 18 out", "oh red stones fall over quiet water near green small hills while cold winds carry dry leaves beyond broken walls"]
    texts[8] = texts[8].replace("convert", "Convert")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(rows, bench).collect()}
    assert set(got) == {(k, 0) for k in range(7)} | {(7, 1), (8, 2), (9, 3), (11, 4), (12, 5), (14, 6)}
    assert got[8, 2]["start"] == 1
    assert [got[k, 0]["start"] for k in range(7)] == list(range(7))
    assert got[14, 6]["coverage"] == 1.0 and got[14, 6]["start"] == 1 and got[8, 2]["n_changed"] == 2


def test_mixing(spark, docs, empty):
    rows = spark.createDataFrame([(i, "a b c d", "big" if i < 80 else "small") for i in range(100)], "doc_id long, text string, source string")
    got = mixing.mix_sources(rows, entropy=0.9).collect()
    per = {s: sum(1 for r in got if r["source"] == s) for s in ("big", "small")}
    assert per["big"] == 80 and {r["doc_id"] for r in got} == set(range(100)) and 20 < per["small"] <= 80
    assert mixing.mix_sources(empty).count() == 0
    assert {r["doc_id"] for r in mixing.mix_sources(docs).collect()} == {r["doc_id"] for r in docs.collect()}


def test_personal(spark, empty):
    t = "x a.b@c.de y +1 (499) 555-6503 z 10.0.0.256 10.0.0.1 n 4111 1111 1111 1111 é@ü"
    rows = spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in personal_data.personal_spans(rows, None).select("doc_id", personal_data.joined("spans").alias("spans")).collect()}
    at = lambda k, s: f"{k}:{t.index(s)}:{t.index(s) + len(s)}"
    assert got[1] == ",".join([at("email", "a.b@c.de"), at("ip", "10.0.0.1 ")[:-2] + str(t.index("10.0.0.1 ") + 8), at("card", "4111 1111 1111 1111"), at("phone", "+1 (499) 555-6503")]) and got[2] == got[3] == ""
    assert personal_data.train(empty) is None


def test_personal_rare_kinds(spark):
    texts = [f"mail bob{i}[at]site{i}.com now" if i % 2 else f"we meet at home{'x' * (i % 5)}. Then go" for i in range(240)]
    rows = [(i, t) for i, t in enumerate(texts)]
    ids = {r["id"] for r in spark.range(240).orderBy(F.xxhash64("id"), "id").limit(60).collect()}
    rare = next(i for i in range(239, 0, -1) if i not in ids and i % 2 == 0)
    key = "api_token = '" + "a1B2" * 70 + "'"
    rows[rare] = (rare, f"ssn 123-45-6789 and {key} done")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = personal_data.train(df, max_docs=60)
    assert set(model.thresholds) == set(range(len(personal_data.KINDS))) and model.thresholds[personal_data.KINDS.index("iban")] < 1
    assert model.thresholds[personal_data.KINDS.index("iban")] >= 0.5
    found = [c["kind"] for r in df.where(F.col("doc_id") == rare).select(personal_data.candidates(F.col("text")).alias("c")).collect() for c in r["c"]]
    assert personal_data.KINDS.index("secret") in found and personal_data.KINDS.index("ssn") in found
    one = spark.createDataFrame([(1, "ssn 123-45-6789 x")], "doc_id long, text string")
    got = personal_data.personal_spans(one, personal_data.train(one)).select(personal_data.joined("spans").alias("s")).first()
    assert "ssn:4:15" in got["s"].split(",")


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    model = line_crf.train(empty, labels)
    got = line_crf.score_documents(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)


def test_quality_learns():
    good, bad = [text_of(i, 30).encode() for i in range(40)], [text_of(i, 30).upper().replace(" ", "!! ").encode() for i in range(40)]
    x, length, doc = line_crf.line_features(good[:30] + bad[:30])
    model = line_crf.fit_line_crf(x, length, doc, np.array([1.0] * 30 + [0.0] * 30))
    s = model.score(good[30:] + bad[30:] + [b""])
    assert (s[:10] > 0.5).all() and (s[10:20] < 0.3).all()


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in graph_search.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    hit = total = 0
    for q in range(0, 600, 20):
        s = x.astype(float) @ x[q].astype(float)
        order = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        hit, total = hit + len(set(order) & set(got[q].values())), total + 20
    assert len(got) == 30 and hit / total >= 0.95


def test_nearest_in_double_precision(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 6)) * np.where(np.arange(120) % 3 == 0, 1e60, 1.0)[:, None]
    x[5] = x[4] * (1 + 1e-12)  # equal in single precision
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in graph_search.nearest(df, F.col("vec_id") % 20 == 0, k=200).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 120, 20):
        s = [(i, sum(a * b for a, b in zip(x[i].tolist(), x[q].tolist()))) for i in range(120)]
        found = sorted(got[q])
        assert all(abs(score - s[i][1]) <= 1e-12 * np.abs(x[i] * x[q]).sum() for _, i, score in found)
        best = [i for i, _ in sorted((c for c in s if c[0] != q), key=lambda c: (-c[1], c[0]))][:20]
        assert len(set(best) & {i for _, i, _ in found[:20]}) >= 19


def test_hash_of_lines():
    assert line_dedup.line_key(" \tAbÉ ") == "abÉ" and hashlib.sha256(b"").hexdigest()


def test_line_keys_are_taken_from_each_text_once(spark, tmp_path, monkeypatch):
    """The draw of range bounds reads the written keys, not the texts again."""
    from tapeworks.llm import line_dedup

    seen = tmp_path / "seen"
    seen.mkdir()
    plain = line_dedup._keys

    def counted(min_length):
        take = plain(min_length)

        def rows(batches):
            import uuid

            def told():
                for pdf in batches:
                    for doc in pdf["doc_id"]:
                        (seen / f"{doc}-{uuid.uuid4()}").touch()
                    yield pdf

            yield from take(told())

        return rows

    monkeypatch.setattr(line_dedup, "_keys", counted)
    docs = spark.createDataFrame([(k, f"the line that all of them hold\nown line {k} of this text alone") for k in range(6)], "doc_id long, text string")
    got = {r["doc_id"] for r in line_dedup.line_bitmaps(docs).collect()}
    assert got == set(range(5))
    assert sorted(int(p.name.split("-")[0]) for p in seen.iterdir()) == list(range(6))
