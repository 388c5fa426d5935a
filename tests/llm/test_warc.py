import base64
import gzip
import hashlib

from tidemark.llm.warc import read_archives, write_archives

ROWS = [(i, f"http://x.org/{i}", f"<p>page {i % 40}</p>" * (1 + i % 40)) for i in range(200)]
ROWS += [(300, None, None), (301, "http://e/", ""), (302, "http://l/", "é\r\n\r\nlong " * 40_000), (303, "http://odd/\r\nX: y", "odd"), (7, "http://x.org/7", "<p>page 7</p>" * 8), (None, "http://n/", "none"), (None, "http://m/", "none"), (None, "http://x/", "<p>page 0</p>")]


def expected(rows, least=0):
    best = {}
    for k, _, t in rows:
        t = (t or "").encode()
        if t not in best or best[t] is None or (k is not None and k > best[t]):
            best[t] = k
    seen, out = set(), []
    for k, _, t in rows:
        t = (t or "").encode()
        digest = base64.b32encode(hashlib.sha1(t).digest()).decode()
        shared = len(t) >= least and sum((x or "").encode() == t for _, _, x in rows) > 1
        repeated = shared and (k != best[t] or (k, t) in seen)
        seen.add((k, t))
        out.append((str(k), len(t), digest, "revisit" if repeated else "response", best[t] if repeated else None))
    return sorted(out, key=str)


def read(manifest):
    return sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_archives(manifest, payload=False).collect()), key=str)


def frame(spark, parts):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as key", "'x' as payload", "2 as shard").repartition(parts)


def test_archives_give_back_every_page(spark, tmp_path):
    for least in (0, 20):
        manifest = write_archives(frame(spark, 3), f"{tmp_path}/a{least}", least_bytes=least, roll_bytes=2_000)
        assert read(manifest) == expected(ROWS, least)
    files = [r.path for r in manifest.collect()]
    assert len(files) > 8 and not list((tmp_path / "a20").glob("*.tmp"))
    payloads = {r.payload.decode() for r in read_archives(manifest).filter("record_type = 'response'").collect()}
    assert payloads == {t or "" for _, _, t in ROWS}
    assert gzip.open(files[0]).read(8) == b"WARC/1.1"


def test_files_do_not_depend_on_partitioning(spark, tmp_path):
    files = []
    for parts in (1, 2, 7, 30):
        manifest = write_archives(frame(spark, parts), f"{tmp_path}/{parts}", roll_bytes=3_000, shard_bytes=20_000)
        files.append(sorted(manifest.drop("path").collect(), key=str))
        assert spark.read.parquet(f"{tmp_path}/{parts}/manifest").count() == len(files[-1])
    assert len({r.shard for r in files[0]}) > 5
    assert files[0] == files[1] == files[2] == files[3]


def test_a_key_that_cannot_be_null(spark, tmp_path):
    pages = spark.range(500).selectExpr("id as page_id", "concat('http://x/', id) as url", "repeat('p', cast(id % 50 as int)) as html").repartition(2)
    rows = [(i, f"http://x/{i}", "p" * (i % 50)) for i in range(500)]
    assert read(write_archives(pages, f"{tmp_path}/range", shard_bytes=1_000)) == expected(rows)


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_archives(write_archives(empty, f"{tmp_path}/none")).count() == 0
