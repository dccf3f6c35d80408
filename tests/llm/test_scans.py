"""Host rules, archive, licenses and URLs."""

import base64
import hashlib
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from traceloom.llm import host_rules, licenses, url_filter, warc

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_measures(odd, empty, spark):
    more = spark.createDataFrame(
        [(20, "a b c a b c a b c", "h"), (21, "x y z q x y z\nx\n\nx\n# %", "h")], "doc_id BIGINT, text STRING, source STRING"
    )
    docs = odd.select("doc_id", "text", "source").union(more)
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    got = {}
    for r in host_rules.measures(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words))
    for doc_id, text in texts:
        w = brute.words(text)
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [line for line in (text or "").split("\n") if brute.words(line)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated))
        assert want in got[doc_id]
    assert len(host_rules.judge(docs).collect()) == docs.count()
    assert host_rules.judge(empty).collect() == []


def test_a_failing_host_takes_its_documents(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good if i % 10 else "# # # x", f"h{i % 3}") for i in range(300)]
    rows += [(1000 + i, good if i == 0 else "# $ % y", "bad") for i in range(40)] + [(2000, "short", "tiny"), (2001, good, None)]
    out = {r.doc_id: r for r in host_rules.judge(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")).collect()}
    assert not out[1000].base_failed and out[1000].host_failed and not out[1000].kept
    assert out[1].kept and out[2001].kept and not out[0].kept
    assert not out[2000].host_failed or out[2000].base_failed


def test_a_host_is_judged_against_the_mean_host(spark):
    """Failures well above the mean reject a host among clean ones; one of two in a tiny host weighs less."""
    good = " ".join(f"w{i}" for i in range(80))
    hosts = {f"h{k}": (100, 1) for k in range(30)} | {"worse": (100, 25), "tiny": (2, 1)}
    rows = [(len(hosts) * i + k, good if i >= bad else "short", h) for k, (h, (n, bad)) in enumerate(hosts.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING").withColumn("host", F.lit("clash"))
    measured = host_rules.measures(docs)
    found = {r.host: r for r in host_rules.host_verdicts(measured).collect()}
    assert found["worse"].host_failed and not any(found[f"h{k}"].host_failed for k in range(30))
    n, k = 100, 25
    rates = [bad / n for n, bad in hosts.values()]
    mean = sum(rates) / len(rates)
    variance = sum((x - mean) ** 2 for x in rates) / len(rates)
    drawn = mean * (1 - mean) * sum(1 / n for n, _ in hosts.values()) / len(rates)
    strength = max(mean * (1 - mean) / max(variance - drawn, 1e-9) - 1, 1.0)
    assert abs(found["worse"].rate_short - (k + mean * strength) / (n + strength)) < 1e-9
    assert found["tiny"].rate_short < 0.5 - 0.05
    assert not any(r.host_failed for r in host_rules.host_verdicts(measured, margin=0.9).collect())
    out = host_rules.judge(docs)
    assert out.where("host_failed").count() == 100 + 2 * found["tiny"].host_failed
    assert out.where("kept").count() == sum(n - bad for n, bad in hosts.values()) - 75 - found["tiny"].host_failed


def test_archive(spark, tmp_path):
    rows = [(1, "http://a/1", "x"), (2, "http://a/2", "x"), (3, "u\r\nX: y", "é"), (4, None, None), (5, "e", ""), (5, "e", ""), (None, "n", "x")]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    out = Counter(tuple(r) for r in warc.archived(pages).collect())
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    latest = {"x": 2, "é": 3, "": 5}
    want = Counter()
    for page_id, _, html in rows:
        to = latest[html or ""]
        want[page_id, len((html or "").encode()), sha(html), "response" if page_id == to else "revisit", None if page_id == to else to] += 1
    assert out == want
    path = str(tmp_path / "a")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    for r in warc.records(warc.read_archive(spark, path)).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and body[size:] == b"\r\n\r\n"
        assert b"X: y" not in head.split(b"\r\n")
    whole = Counter((r.page_id, bytes(r.record)) for r in warc.records(warc.read_archive(spark, path)).collect())
    light = warc.read_archive(spark, path, revisits=False)
    assert Counter((r.page_id, bytes(r.record)) for r in warc.records(light).collect()) == whole
    assert light.where("payload IS NULL").count() == 3
    large = {r.record_type for r in warc.archived(pages, least_bytes=9).collect()}
    assert large == {"response"}
    assert warc.archived(pages.where("false")).collect() == []


def test_damaged_archive_is_refused(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id BIGINT, url STRING, html STRING")
    path = str(tmp_path / "b")
    warc.write_archive(pages, path)
    spark.read.parquet(f"{path}/payloads").selectExpr("unhex('00') AS sha256", "body").write.parquet(str(tmp_path / "c/payloads"))
    spark.read.parquet(f"{path}/headers").write.parquet(str(tmp_path / "c/headers"))
    with pytest.raises(Exception, match="missing or damaged"):
        warc.read_archive(spark, str(tmp_path / "c")).collect()


def test_headers_are_checked(spark, tmp_path):
    """A header whose payload is gone, or is another one, is refused, also where only headers are read."""
    pages = spark.createDataFrame([(1, "u", "x"), (2, "v", "y")], "page_id BIGINT, url STRING, html STRING")
    path = str(tmp_path / "a")
    warc.write_archive(pages, path)
    payloads, headers = spark.read.parquet(f"{path}/payloads"), spark.read.parquet(f"{path}/headers")
    payloads.limit(1).write.parquet(str(tmp_path / "gone/payloads"))
    headers.write.parquet(str(tmp_path / "gone/headers"))
    payloads.write.parquet(str(tmp_path / "other/payloads"))
    swapped = headers.join(headers.select(F.col("page_id").alias("p"), F.col("sha256").alias("s")), F.col("page_id") != F.col("p"))
    swapped.select("page_id", F.col("s").alias("sha256"), "header").write.parquet(str(tmp_path / "other/headers"))
    for name, message in [("gone", "missing or damaged"), ("other", "another payload")]:
        for read in (warc.read_headers, warc.read_archive):
            with pytest.raises(Exception, match=message):
                read(spark, str(tmp_path / name)).collect()


def test_odd_pages(spark):
    """Very long and repeated html, extra columns with names the operator uses."""
    rows = [(1, "u", "é" * 2_000_000)] + [(i, None, "same") for i in range(2, 60)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").withColumns({"sha256": F.lit("x"), "bytes": F.lit(1)})
    out = {r.page_id: r for r in warc.archived(pages).collect()}
    assert out[1].payload_bytes == 4_000_000 and out[1].record_type == "response"
    assert sorted(i for i, r in out.items() if r.record_type == "response") == [1, 59]
    assert {r.refers_to for r in out.values()} == {None, 59}


def base(text):
    w = TOKEN.findall(brute.lower(text))
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def test_licenses(spark, odd, empty):
    mit = licenses.TEMPLATES[2][1]
    cut = mit.split()
    rows = [
        (1, "intro words here\n" + mit.upper() + "\nmore"),
        (2, "x " + " ".join(cut[:20] + ["really"] + cut[20:35] + cut[36:]) + " y"),
        (3, "we have a license to the free software world"),
        (4, "Licensed under CC BY-NC 4.0. all  rights-reserved ALL RIGHTS RESERVED"),
        (5, mit + " " + mit),
    ]
    docs = odd.select("doc_id", "text").where("doc_id > 5").union(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    out = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, text in [tuple(r) for r in docs.collect()]:
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
    assert [out[i].labels for i in (1, 2, 3, 5)] == ["mit", "mit", "", "mit"]
    assert out[4].labels == "cc-by,cc-by-nc,reserved" and out[4].score == 1 and out[3].score == 0
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty).collect() == []
    found = licenses.spans(docs.where("doc_id = 2")).collect()
    assert [(r.first_word, r.last_word) for r in found] == [(1, len(TOKEN.findall(mit.lower())))]


def test_repeated_rows_vote_once(spark, monkeypatch):
    """Part of a template stays part of it, however many rows hold it and whatever their ids."""
    text = dict(licenses.TEMPLATES)["mpl-2.0"].split()
    part, most = " ".join(text[:9]), " ".join(text[:14])
    rows = [(1, part), (1, part), (2, part), (None, part), (None, part), (3, most), (3, most), (3, None), (None, most)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("h1", F.lit(1))
    for bound in (licenses.BROADCAST_GRAMS, 0):
        monkeypatch.setattr(licenses, "BROADCAST_GRAMS", bound)
        out = licenses.scan(docs).collect()
        assert len(out) == len(rows)
        assert {(r.labels, r.score) for r in out if r.n_words == 9} == {("", 0.0)}
        scores = [(r.doc_id, r.labels, r.score) for r in out if r.n_words == 14]
        assert sorted(scores, key=repr) == [(3, "mpl-2.0", scores[0][2])] * 2 + [(None, "mpl-2.0", scores[0][2])]
        assert len(licenses.spans(docs).collect()) == 3


def test_urls(spark):
    urls = [
        "http://x.NET/a?b#c",
        "https://Example.net/en/1",
        "http://a.example.net/enx",
        "http://example.com/de/",
        "http://notexample.com/de/",
        "http://org/fr/x",
        "x.org/fr/",
        None,
        "",
        "ftp://a.org?q=/fr/",
        "http://y.net",
        "https://cheap-pills.example.com/en/1",
        "a://b://c/d",
    ]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id INT, url STRING, host INT")
    out = {r.page_id: r for r in url_filter.filter_urls(df, url_filter.labelled_urls(spark)).collect()}
    assert len(out) == len(urls)
    assert [out[i].rule for i in range(7)] == ["net/", "example.net/en/", "net/", "example.com/de/", None, "org/fr/", None]
    assert (out[0].host, out[0].path, out[0].verdict) == ("x.net", "/a", "block")
    assert (out[7].host, out[7].path, out[8].host, out[6].host) == ("", "", "", "")
    assert (out[9].host, out[9].path, out[10].path, out[10].rule) == ("a.org", "", "", None)
    assert out[1].verdict == "allow" and out[11].verdict == "block"
    assert (out[12].host, out[12].path) == ("b:", "//c/d")
    labelled = url_filter.labelled_urls(spark)
    judged = url_filter.filter_urls(labelled.selectExpr("label AS page_id", "url"), labelled, rules=())
    assert judged.where("(page_id = 1) <> (verdict = 'block')").count() == 0
    assert url_filter.filter_urls(df.where("false"), labelled).collect() == []


def test_long_urls_take_linear_time(spark):
    """N-grams are those of the whole url, whatever its length; equal urls have equal verdicts."""
    tails = {n: "/" + "ab𝔘c" * (n // 4) for n in (8, 400, 60_000)}
    rows = [(n, "http://a.b" + t) for n, t in tails.items()] * 2 + [(None, "http://a.b/"), (1, None)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING").withColumns({"in_host": F.lit(1), "score": F.lit(2)})
    cut = url_filter._with_buckets(pages.select("page_id", "url").where("page_id = 400")).first()

    def hashed(kind, text):
        grams = {text[i : i + n] for n in url_filter.LENGTHS for i in range(len(text) - n + 1)}
        df = spark.createDataFrame([(g,) for g in grams], "g STRING")
        return {r[0] for r in df.select(F.pmod(F.xxhash64(F.lit(kind), "g"), F.lit(url_filter.FEATURES))).collect()}

    assert set(cut.buckets) == hashed(0, ".a.b/") | hashed(1, tails[400])
    out = url_filter.filter_urls(pages, url_filter.labelled_urls(spark)).collect()
    assert len(out) == len(rows) and len({(r.page_id, r.score, r.verdict) for r in out}) == 5
    began = time.perf_counter()
    url_filter._with_buckets(pages.select("page_id", "url")).select(F.size("buckets")).collect()
    assert time.perf_counter() - began < 60
