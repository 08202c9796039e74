"""End to end: fixture payloads landed as files, one run of the batch job, rerun is idempotent."""

import gzip
import json
import os
import uuid

from curata.operators import dedup
from curata.plans.job import run_job
from curata.session import checkpoint_dir
from curata.sources import feeds
from curata.sources import fixtures as FX
from curata.sources import landed
from curata.sources.landed import land_fixture, read_sources
from curata.streaming import stream

SF = "/root/testdata/sf0.001"


def test_landed_sources_equal_in_memory_parse(spark):
    from curata.plans import q_sources

    root = f"{checkpoint_dir(spark).rstrip('/')}/landing-{uuid.uuid4().hex}"
    land_fixture(spark, SF, root)
    got = read_sources(spark, root, FX.as_of())
    want = q_sources.q_src_union(spark, SF)
    cols = feeds.ARTICLE_COLUMNS
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(map(tuple, want.select(*cols).collect()), key=repr)
    assert got.select("seq").distinct().count() == got.count()


def test_run_job_idempotent(spark):
    base = f"{checkpoint_dir(spark).rstrip('/')}/job-{uuid.uuid4().hex}"
    land_fixture(spark, SF, f"{base}/landing")
    first = sorted(r["id"] for r in run_job(spark, f"{base}/landing", f"{base}/tables", FX.as_of(), 2024013023, force=True).collect())
    again = sorted(r["id"] for r in run_job(spark, f"{base}/landing", f"{base}/tables", FX.as_of(), 2024013023, force=True).collect())
    assert first == again and 0 < len(first) <= 30
    assert stream.current_state(spark, f"{base}/tables").first()["last_run_status"] == "success"


def test_no_source_folder_is_an_empty_run(spark):
    base = f"{checkpoint_dir(spark).rstrip('/')}/job-{uuid.uuid4().hex}"
    assert run_job(spark, f"{base}/nothing", f"{base}/tables", FX.as_of(), 2024013023).count() == 0
    assert stream.current_state(spark, f"{base}/tables").first()["last_run_status"] == "failed: No articles fetched from any source"


def test_rejects_are_written(spark):
    base = f"{checkpoint_dir(spark).rstrip('/')}/job-{uuid.uuid4().hex}"
    land_fixture(spark, SF, f"{base}/landing")
    run_job(spark, f"{base}/landing", f"{base}/tables", FX.as_of(), 2024013023)
    got = {r.source for r in stream.read_table(spark, f"{base}/tables", "rejects").collect()}
    assert got >= {"hackernews", "reddit", "rss"}


POST = '{"data":{"children":[{"data":{"title":"Same post","url":"https://a.com/%s","score":150,"num_comments":20,"is_self":false,"created_utc":1706600000}}]}}'


def _land(root, files):
    for name, data in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            out.write(data if isinstance(data, bytes) else data.encode())


def test_a_broken_file_leaves_the_others_and_one_reject(spark, tmp_path):
    many = "\n".join(POST % os.urandom(9).hex() for _ in range(3000))
    packed = gzip.compress(many.encode())
    rss = "<rss><channel><item><title>Feed item</title><link>https://f.com/1</link></item></channel></rss>"
    root = str(tmp_path / "landing")
    _land(root, {
        "hn/items/a.json": '{"id":1,"type":"story","score":99,"url":"https://h.com","title":"Story","time":1706600000}', "hn/lists/list_id=0/a.json": "[1]\nnot a list",
        "gnews/a.json.gz": gzip.compress(b'{"articles":[{"title":"News","url":"https://g.com"}]}'), "gnews/cut %20.json.gz": gzip.compress(b"{}" * 4000)[:20],
        "reddit/endpoint=x/a.json.gz": packed[:len(packed) // 2], "reddit/endpoint=x/b.json": POST % "b", "reddit/endpoint=y/junk.json.gz": b"no gzip at all",
        "rss/feed=https%3A%2F%2Ff.com%2Frss/a.xml": rss, "rss/feed=https%3A%2F%2Ff.com%2Frss/b.xml": "<html>down for repairs",
        "rss/feed=https%3A%2F%2Ff.com%2Frss/c.xml": "<rss><channel><item><title>ok</title><link>https://f.com/2</link></item><item><title>x<b></title></item></channel>",
    })
    raw, unread = landed.read_raw(spark, root)
    arts = landed.articles_of(spark, raw, FX.as_of()).collect()
    assert sorted(r.title for r in arts) == ["Feed item", "News", "Same post", "Story", "ok"]
    rejects = [(r.source, r.file.rpartition("/")[2], r.reason) for r in landed.rejects_of(spark, raw, FX.as_of(), unread).collect()]
    assert sorted(rejects) == [("gnews", "cut %20.json.gz", "unreadable"), ("hackernews", "a.json", "malformed"), ("reddit", "a.json.gz", "unreadable"),
                               ("reddit", "junk.json.gz", "unreadable"), ("rss", "b.xml", "no_items"), ("rss", "c.xml", "malformed")]


def test_equal_posts_are_counted_and_the_earlier_one_stays(spark, tmp_path):
    root = str(tmp_path / "landing")
    _land(root, {f"reddit/endpoint={e}/a.json": "\n".join([POST % "same"] * 2) for e in ("a", "b")})
    arts = landed.read_sources(spark, root, FX.as_of())
    rows = arts.orderBy("seq").collect()
    assert len(rows) == 4 and [r.description.split(" ")[0] for r in rows] == ["a", "a", "b", "b"]
    assert [r.description.split(" ")[0] for r in dedup.dedup_url(arts).collect()] == ["a"]
    run_job(spark, root, str(tmp_path / "tables"), FX.as_of(), 2024013023)
    assert stream.current_state(spark, str(tmp_path / "tables")).first()["last_article_count"] == 1


def test_a_provider_is_asked_once_for_each_prompt(spark, tmp_path):
    root, tables, asked = str(tmp_path / "landing"), str(tmp_path / "tables"), str(tmp_path / "asked")
    os.makedirs(asked)
    titles = {"good": "A plain answer of more than five words", "short": "No", "blank": " ", "never": "Not"}
    items = "".join(f"<item><title>{t} title {k}</title><link>https://{t}.com</link><description>{t} description in the feed</description></item>" for k, t in enumerate(titles))
    _land(root, {"rss/feed=https%3A%2F%2Ff.com/a.xml": f"<rss><channel>{items}</channel></rss>"})

    def provider(prompts):
        out = []
        for p in prompts:
            with open(os.path.join(asked, os.urandom(8).hex()), "w") as f:
                f.write(p)
            kind = next(t for t in titles if f"{t} title" in p)
            answer = "The simple prompt had an answer of its own" if kind == "short" and "Headline:" in p else titles[kind]
            out.append(json.dumps({"candidates": [{"content": {"parts": [{"text": answer}]}}]}))
        return out

    got = {}
    for _ in range(2):
        run_job(spark, root, tables, FX.as_of(), 2024013023, force=True, provider=provider)
        news = {r.title.split()[0]: r.summary for r in stream.read_table(spark, tables, "news_log").collect()}
        assert news == {"good": titles["good"], "short": "The simple prompt had an answer of its own", "blank": "blank description in the feed", "never": "never description in the feed"}
        prompts = sorted(open(os.path.join(asked, f)).read() for f in os.listdir(asked))
        assert len(prompts) == len(set(prompts)) == 6 and got.setdefault("prompts", prompts) == prompts


def test_counts_need_no_job_of_their_own(spark, tmp_path, monkeypatch):
    root, tables = str(tmp_path / "landing"), str(tmp_path / "tables")
    _land(root, {"reddit/endpoint=a/a.json": POST % "x"})
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.count", lambda self: 1 / 0)
    run_job(spark, root, tables, FX.as_of(), 2024013023)
    monkeypatch.undo()
    assert stream.current_state(spark, tables).first()["last_article_count"] == 1
