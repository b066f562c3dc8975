"""Adapters, pages, remote files, registries, sinks, embeddings and streams by example."""

import hashlib
import io
import json
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import embedding
from tessera.operators import chunking, planning, profile, retrieval, store
from tessera.sources import pages, records, remote, sinks
from tessera.streaming import frames, journal_sink


def payloads(spark, *objects):
    rows = [(i, o if isinstance(o, str) else json.dumps(o, ensure_ascii=False)) for i, o in enumerate(objects)]
    return records.parsed(spark.createDataFrame(rows, "ord long, value string"))


def test_adapters(spark):
    case = records.ADAPTERS["cail2022-lcr"]
    got = records.normalized(payloads(spark, {"path": " p ", "ridx": 7, "q": " facts ", "crime": ["a", " ", 3, "a"]}, {"path": "p", "ridx": True, "q": "x"}, {"path": 1}, "[1]", "{bad", "", {"path": "p", "ridx": "8", "q": "x" * 9}), case, version="1", most_chars=8).orderBy("ord").collect()
    assert [r.reason for r in got] == [None, "CAIL2022 ridx is required", "CAIL2022 path is required", "research record must be an object", "research record must be an object", "research text exceeds max_text_chars"]
    assert (got[0].source_record_id, got[0].source_aliases, got[0].text, got[0].labels, got[0].reference) == ("p", ["ridx:7"], "facts", ["a"], "cail2022-lcr:p")
    asked = records.normalized(payloads(spark, {"query_id": 3, "问题": "怎么办", "match_name": ["法"]}), records.ADAPTERS["stard"], version="1").first()
    assert (asked.source_record_id, asked.record_kind, asked.labels) == ("3", "consultation", ["法"])
    ids = planning.query_ids(spark.createDataFrame([("cail2022-lcr", ["ridx:7", "x"], "p"), ("stard", [], "3")], "dataset_name string, source_aliases array<string>, source_record_id string")).collect()
    assert [tuple(r) for r in ids] == [("cail2022-lcr", "7"), ("stard", "3")]


def test_nested_candidates_and_pool(spark):
    meta = lambda **t: {"accusation": ["盗窃罪"], "term_of_imprisonment": t}
    rows = payloads(spark, {"fact": "a", "meta": meta(imprisonment=5)}, {"fact": "a", "meta": meta(imprisonment=9)}, {"fact": "b", "meta": meta(imprisonment=0, death_penalty=True)}, {"fact": 3, "meta": meta(imprisonment=1)}, {"fact": 3, "meta": {"accusation": ["x"]}}, "{", {"fact": "c", "meta": meta(life_imprisonment=True)}, {"fact": "d", "meta": meta()})
    got = records.candidates(rows, nested=True, target="盗窃", most_chars=10)
    scan = records.pooled(got, most_scanned=100, pool=3).orderBy("ord").collect()
    assert [(r.status, r.outcome_bucket) for r in scan] == [("candidate", "up_to_12_months"), ("duplicate", "up_to_12_months"), ("candidate", "death"), ("rejected", None), ("other", None), ("rejected", None), ("candidate", "life")]
    assert all(r.stopped for r in scan)
    assert records.pooled(got, most_scanned=4, pool=9).count() == 4


PAGE = "<div class='detail'><div class='title'>{title}</div><div class='detail_mes'>发布时间：2024-05-06 来源</div><div class='txt_txt'>{body}</div></div><div class='x'><p>outside</p></div>"


def page(title, *paragraphs):
    return PAGE.format(title=title, body="".join(f"<p>{p}</p>" for p in paragraphs))


def test_pages(spark):
    guiding = page("指导性案例12号：甲诉乙案", "关键词  合同 / 违约", "裁判要点", "要点一", "基本案情 甲说", "裁判理由：理由")
    listed = page("参考", "入库编号：2024-01-2-003-004", "关键词", "一 二", "裁判要旨 x", "基本案情", "y")
    typical = page("典型案例", "前言", "案例一：某公司——甲诉乙案", "【基本案情】", "a", "【裁判结果】", "b", "【典型意义】", "c", "案例二", "标题案", "〖基本案情〗", "d", "责任编辑：某", "尾")
    rows = [(1, guiding, None), (2, listed, None), (3, typical, [1]), (4, typical, [2]), (5, typical, [3]), (6, None, None), (7, page("无号", "文"), None)]
    got = {}
    for r in pages.parse_pages(spark.createDataFrame(rows, "id long, html string, ordinals array<int>"), ordinals="ordinals").collect():
        got[r.id] = r
    assert (got[1].case_number, got[1].title, got[1].keywords, got[1].published_on) == ("指导性案例12号", "甲诉乙案", ["合同", "违约"], "2024-05-06")
    assert got[1].content == "案例信息\n关键词\n合同 违约\n裁判要点\n要点一\n基本案情\n甲说\n裁判理由\n理由"
    assert (got[2].case_number, got[2].keywords) == ("入库编号 2024-01-2-003-004", ["一", "二"])
    assert (got[3].case_number, got[3].title, got[3].content) == ("最高法典型案例 2024-05-06 案例一", "甲诉乙案", "案例信息\n甲诉乙案\n基本案情\na\n裁判结果\nb\n典型意义\nc")
    assert [got[i].failure for i in (4, 5, 6, 7)] == ["sections are incomplete", "selected cases were not found: 3", "page has no readable content", "case number was not found"]
    assert pages.sections("<div class='detail'><div class='title'>t</div><div class='txt_txt'>a<br>b <p>c<p>d</div>")[2] == ["a", "b", "c", "d"]


class Response(io.BytesIO):
    def __init__(self, data, url, status=200, **headers):
        super().__init__(data)
        self.url, self.status, self.headers = url, status, {k.replace("_", "-"): v for k, v in headers.items()}

    def geturl(self):
        return self.url


def test_remote_files(tmp_path):
    data, url = b"x" * 100_000, "https://h.example/f"
    spec = remote.RemoteFile(url, "h.example", len(data), hashlib.sha256(data).hexdigest())
    opened = []
    opener = lambda request, timeout: opened.append(request) or Response(data, url)
    got = remote.acquire_file(spec, tmp_path / "d" / "f", opener=opener)
    assert (got.outcome, got.downloaded) == ("downloaded", len(data)) and (tmp_path / "d" / "f").read_bytes() == data
    assert remote.acquire_file(spec, tmp_path / "d" / "f", opener=opener).outcome == "unchanged" and len(opened) == 1
    for bad in (b"y" * 100_000, data[:-1], data + b"z"):
        with pytest.raises(remote.AcquisitionError):
            remote.acquire_file(spec, tmp_path / "g", opener=lambda *a, b=bad, **k: Response(b, url))
    with pytest.raises(remote.AcquisitionError):
        remote.acquire_file(spec, tmp_path / "g", opener=lambda *a, **k: Response(data, "https://evil.example/f"))
    with pytest.raises(remote.AcquisitionError):
        remote.acquire_file(remote.RemoteFile("http://h.example/f", "h.example", 1, "0" * 64), tmp_path / "g")
    assert not (tmp_path / "g").exists() and [p.name for p in tmp_path.iterdir()] == ["d"]
    remote.write_acquisition(got, {"name": "f"}, tmp_path / "f.source.json")
    assert json.loads((tmp_path / "f.source.json").read_text())["source"] == {"name": "f"}


def test_zip_members(tmp_path):
    import zipfile

    body = b"some text " * 5000
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("first.txt", "1")
        z.writestr("dir/second.txt", body)
        info = z.getinfo("dir/second.txt")
    archive, url = whole.getvalue(), "https://h.example/a.zip"

    def opener(request, timeout):
        if request.get_method() == "HEAD":
            return Response(b"", url, Content_Length=str(len(archive)), ETag="e1")
        first, last = map(int, request.get_header("Range").removeprefix("bytes=").split("-"))
        return Response(archive[first : last + 1], url, 206, Content_Range=f"bytes {first}-{last}/{len(archive)}")

    spec = remote.ZipMember(url, "h.example", len(archive), "e1", "dir/second.txt", info.header_offset, zlib.crc32(body), info.compress_size, len(body))
    got = remote.acquire_zip_member(spec, tmp_path / "m", opener=opener)
    assert (tmp_path / "m").read_bytes() == body and (got.outcome, got.downloaded) == ("downloaded", info.compress_size)
    assert remote.acquire_zip_member(spec, tmp_path / "m", opener=opener).outcome == "unchanged"
    from dataclasses import replace

    for other in (replace(spec, member="x"), replace(spec, crc32=1), replace(spec, etag="e2"), replace(spec, header_at=0)):
        with pytest.raises(remote.AcquisitionError):
            remote.acquire_zip_member(other, tmp_path / "n", opener=opener)


def test_registry_and_manifest(spark, tmp_path):
    file = {"name": "q", "purposes": ["queries", "x"], "path": "p", "source_url": "u", "allowed_hostname": "h", "size_bytes": 3, "sha256": "0"}
    (tmp_path / "r.json").write_text(json.dumps([{"name": "d", "version": "1", "permitted_scopes": ["s"], "files": [file, file | {"purposes": ["y"]}]}]))
    registry = remote.read_registry(spark, str(tmp_path / "r.json"))
    assert remote.file_for(registry, "d", ["queries"])["size_bytes"] == 3
    with pytest.raises(ValueError):
        remote.file_for(registry, "d", ["queries", "y"])
    got = remote.parse_manifest(spark.createDataFrame([(json.dumps([" u1 ", {"url": "u2", "case_ordinals": [2, 1, 2]}, {"url": "u3"}]),)], "value string")).collect()
    assert [tuple(r) for r in got] == [("u1", []), ("u2", [2, 1]), ("u3", [])]
    for bad in ([3], [{"url": 1}], [{"url": "u", "case_ordinals": [True]}], [" "]):
        with pytest.raises(Exception, match="entries"):
            remote.parse_manifest(spark.createDataFrame([(json.dumps(bad),)], "value string")).collect()
    status = remote.licence_status(spark.createDataFrame([("a",), ("b",)], "dataset string"), spark.createDataFrame([("a", "approved")], "dataset string, license_review_status string"))
    assert {tuple(r) for r in status.collect()} == {("a", "approved"), ("b", "unrecorded")}


def test_sinks(spark, tmp_path):
    sources = spark.createDataFrame([("7", "t", ["a", "b"])], "source_id string, title string, chunks array<string>")
    path = str(tmp_path / "s")
    first = {sinks.write_sources(sources, path) for _ in range(2)}
    stored = sinks.Committed(spark, path)
    assert len(first) == 1 and stored.names() == sorted(first)
    assert sorted((r.chunk_index, r.content, r.reference) for r in stored.read("chunks").collect()) == [(1, "a", "L7:C1"), (2, "b", "L7:C2")]
    report = spark.createDataFrame([(1, False)], "n int, passed boolean")
    assert sinks.write_report(report, str(tmp_path / "r"), failed=~F.col("passed")) == 2 and spark.read.json(str(tmp_path / "r")).first().n == 1
    got = sinks.touched(spark.createDataFrame([(1, "old"), (2, "old")], "id int, updated_at string"), spark.createDataFrame([(2,), (2,)], "id int"), key="id", at=F.lit("now"))
    assert {tuple(r) for r in got.select("id", "updated_at").collect()} == {(1, "old"), (2, "now")}


def test_committed_batches(spark, tmp_path):
    """Ids that repeat, equal ids with other content, and a writer that breaks off."""
    path = str(tmp_path / "s")
    of = lambda *rows: spark.createDataFrame(list(rows), "source_id long, title string, chunks array<string>")
    batches = [of((1, "a", ["x"]), (1, "a", ["x"])), of((2, "b", ["y"]), (2, "b", ["y"])), of((1, "a", ["x"])), of((1, "a", ["z"])), of((1, None, ["x"])), of((1, "a", []))]
    names = [sinks.write_sources(b, path) for b in batches]
    assert len(set(names)) == len(batches)
    assert sinks.write_sources(batches[0].repartition(3).orderBy("title"), path) == names[0]
    stored = sinks.Committed(spark, path)
    assert stored.read("sources").count() == 8 and stored.read("chunks").count() == 7
    assert stored.read("sources", [names[1]]).count() == 2
    broken = of((9, "q", ["w"])).withColumn("bad", F.when(F.col("source_id") == 9, F.raise_error(F.lit("broken"))).cast("string"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_sources(broken, path)
    assert stored.read("sources").count() == 8
    with pytest.raises(FileNotFoundError):
        sinks.Committed(spark, str(tmp_path / "none")).read("sources")


def test_embeddings(spark):
    class Broken(embedding.HashEmbedder):
        def embed(self, texts):
            return [[float("nan")]] * len(texts)

    rows = spark.createDataFrame([(i, f"word{i % 3} x") for i in range(150)], "id int, content string")
    got = {r.id: r.embedding for r in embedding.embedded(rows, embedding.HashEmbedder(8), key="id").collect()}
    assert len(got) == 150 and got[0] == got[3] and got[0] != got[1] and abs(sum(x * x for x in got[0]) - 1) < 1e-9
    with pytest.raises(Exception, match="not finite"):
        embedding.embedded(rows, Broken(), key="id").collect()
    with pytest.raises(RuntimeError):
        embedding.checked([[1.0], [1.0, 2.0]], 2)


def test_frames():
    assert frames.frames("id: 1\nevent: a\ndata: x\ndata:y\n\n: note\ndata: z\r\n\r\ndata: lost") == [("1", "a", "x\ny"), (None, "message", "z")]
    assert frames.frames("event: e\n\ndata\n\n") == [(None, "message", "")]
    done = 'event: messages\ndata: {"delta": "a"}\n\nevent: complete\ndata: {"result": {"k": 1}}'
    assert frames.observed(done) == ("a", 1, '{"k": 1}', None, False)
    assert frames.observed('{"type": "delta", "delta": "a"}\n{"type": "end"}', ndjson=True)[3] == "stream ended without a complete event"
    for text, failure in [("data: {", "stream returned invalid SSE data"), ("data: [1]\n\n", "stream returned non-object SSE data"), ("event: gap\ndata: {}\n\n", "stream replay gap prevented complete observation"), (done + "\n\n" + done, "stream returned multiple complete events"), ("event: odd\ndata: {}\n\n", "stream returned unknown event type: odd"), ('event: messages\ndata: {"delta": ""}\n\n', "stream returned an empty delta")]:
        assert frames.observed(text)[3] == failure, text


def test_measured_slices():
    import random

    rnd = random.Random(4)
    for _ in range(60):
        text = "".join(rnd.choice("ab1. 中，\n-_/+") for _ in range(rnd.randint(1, 40)))
        measured = chunking.Measured(text)
        for _ in range(40):
            a, b = sorted(rnd.randrange(len(text) + 1) for _ in range(2))
            assert measured.estimate(a, b) == chunking.estimate(text[a:b]) == plain_estimate(text[a:b])
        for most in (1, 3, 7):
            fits = [n for n in range(1, len(text) + 1) if plain_estimate(text[:n]) <= most]
            assert chunking.longest_prefix(text, most) == max(fits, default=1)
            ends = [n for n in range(1, len(text) + 1) if plain_estimate(text[-n:]) <= most]
            assert chunking.longest_suffix(text, most) == max(ends, default=1)
    with pytest.raises(ValueError):
        chunking.register_splitter("recursive", chunking.split_blocks)


def plain_estimate(text):
    import re

    from tessera.functions.text import CJK_CHAR, WORD

    if not text:
        return 0
    cjk = len(re.findall(CJK_CHAR, text))
    return max(1, cjk + len(re.findall(WORD, text)) + (len(text) - cjk) // 8)


def test_plans_and_scenarios(spark):
    assert planning.canonical_identity({"b": 1, "a": "é"}) == "sha256:" + hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest()
    assert planning.dataset_identity(" " + "A" * 64, path="p", size=1, modified=2) == ("sha256:" + "a" * 64, True)
    with pytest.raises(ValueError):
        planning.dataset_identity("xyz", path="p", size=1, modified=2)
    s = spark.createDataFrame([("a", [1, 2]), ("b", [1])], "id string, turns array<int>")
    assert [r.id for r in planning.select_scenarios(s, ["b", "a", "b"], most=2).collect()] == ["b", "a"]
    for wanted, most in ((["c"], 2), ([], 1), ([], 0)):
        with pytest.raises(ValueError):
            planning.select_scenarios(s, wanted, most=most)
    assert tuple(planning.suite_plan(s).first()) == (2, 3)
    with pytest.raises(ValueError):
        planning.unique_or_error(s.union(s), ["id"], "ids")


def test_turns(spark):
    turns = spark.createDataFrame([("case_update", [], None, ["q1", "q2"]), ("case_update", [], None, []), ("legal_question", ["t"], "i", ["q1"])], "intent string, answer_targets array<string>, legal_issue string, pending_targets array<string>")
    got = [(r.effective_intent, r.effective_targets, r.effective_issue) for r in profile.effective_turn(turns).collect()]
    assert got == [("legal_question", ["q1", "q2"], "q1"), ("case_update", [], None), ("legal_question", ["t"], "i")]
    have = spark.createDataFrame([(1, "a", "known"), (1, "b", "unknown"), (1, "c", "unknown")], "case_id int, key string, state string")
    kept = profile.committed_factors(have, spark.createDataFrame([(1, "b")], "case_id int, key string"))
    assert sorted(r.key for r in kept.collect()) == ["a", "b"]
    text = profile.retrieval_text(case_type=F.lit("t"), lists=[F.array(F.lit("p"), F.lit(""))], factors=F.array(F.struct(F.lit("known").alias("state"), F.lit("l").alias("label"), F.lit("v").alias("value")), F.struct(F.lit("unknown").alias("state"), F.lit("m").alias("label"), F.lit("w").alias("value"))))
    assert spark.range(1).select(text.alias("x")).first().x == "t p l:v"


def test_index_and_guards(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "doc_id long, content string")
    path = str(tmp_path / "index")
    assert retrieval.build_index(docs, path, identity="one") and not retrieval.build_index(docs, path, identity="one")
    with pytest.raises(ValueError):
        retrieval.build_index(docs, path, identity="two")
    with pytest.raises(ValueError):
        retrieval.build_index(docs.union(docs), str(tmp_path / "other"), identity="x")
    q = spark.createDataFrame([(1, "alpha")], "query_id long, query string")
    assert [r.doc_id for r in retrieval.bm25_rank(q, retrieval.read_index(spark, path, identity="one"), k=5).collect()] == [1]
    assert retrieval.guarded(docs, limit=2).count() == 2
    with pytest.raises(ValueError):
        retrieval.guarded(docs, limit=1)
    with pytest.raises(Exception, match="no row for"):
        store.all_hydrated(spark.createDataFrame([(1,), (9,)], "doc_id long"), docs, key="doc_id").collect()
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "doc_id long, embedding array<double>")
    with pytest.raises(Exception, match="differ in length"):
        retrieval.vector_rank(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>"), v, k=1, strict=True).collect()


def test_journal_stream(spark, tmp_path):
    rows = [("tool.started", '{"tool_name":"search_guiding_cases","secret":"x"}', '{"query":"q"}'), ("other", "{}", "{}")]
    spark.createDataFrame(rows, "event_type string, metadata string, content string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_type string, metadata string, content string").parquet(str(tmp_path / "in"))

    def publish(batch):
        raise RuntimeError("nobody listens")

    journal_sink.run_journal(stream, str(tmp_path / "out"), str(tmp_path / "ck"), publish=publish).awaitTermination()
    [row] = spark.read.parquet(str(tmp_path / "out")).collect()
    assert row.payload == {"runtime_event": "tool.started", "tool_name": "search_guiding_cases", "description": "检索“q”相关的相关案例"}


def plain_split(text, target, most):
    """Sentence by sentence, estimating anew each time."""
    import re

    from tessera.functions.text import SENTENCE_END

    if plain_estimate(text) <= most:
        return [text.strip()] if text.strip() else []
    out = [""]
    for s in filter(None, (s.strip() for s in re.split(SENTENCE_END, text))):
        if plain_estimate(s) > most:
            while s:
                n = max([1, *(i for i in range(1, len(s) + 1) if plain_estimate(s[:i]) <= most)])
                out.append(s[:n].strip())
                s = s[n:].lstrip()
            out.append("")
        elif out[-1] and plain_estimate(out[-1] + s) > target:
            out.append(s)
        else:
            out[-1] += s
    return [x for x in out if x]


def test_chunks_against_a_plain_split(spark):
    import random

    rnd = random.Random(8)
    texts = ["".join(rnd.choice(["word ", "中文字", "x. ", "! ", "\n", "12-3 ", "a_b；", "long" * 9]) for _ in range(rnd.randint(0, 90))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id int, content string")
    got = {}
    for r in chunking.chunk_recursive(docs, target=15, most=22).orderBy("doc_id", "chunk_index").collect():
        assert r.estimated_tokens == plain_estimate(r.content)
        got.setdefault(r.doc_id, []).append(r.content)
    assert got == {i: plain_split(t, 15, 22) for i, t in enumerate(texts) if t.strip()}


def test_merged_blocks_against_a_plain_merge():
    import random

    rnd = random.Random(9)
    policy = chunking.Policy(target=12, most=18)
    for _ in range(80):
        blocks = [{"id": str(i), "parent_id": rnd.choice([None, None, "0", "1"]), "heading": rnd.choice("aab"), "block_type": rnd.choice(["text"] * 5 + ["table"]), "page_start": rnd.choice([None, 1, 2]), "page_end": rnd.choice([None, 1, 2]), "content": "word " * rnd.randint(1, 6) + "x"} for i in range(rnd.randint(1, 12))]
        groups = []
        for b in blocks:
            last = groups[-1][-1] if groups else None
            fits = last is not None and last["heading"] == b["heading"] and (None in (last["page_end"], b["page_start"]) or last["page_end"] == b["page_start"]) and "table" not in (last["block_type"], b["block_type"])
            fits = fits and (last["parent_id"] == b["parent_id"] or b["parent_id"] == last["id"] or last["parent_id"] == b["id"])
            if fits and plain_estimate("\n\n".join(x["content"] for x in [*groups[-1], b])) <= policy.target:
                groups[-1].append(b)
            else:
                groups.append([b])
        assert chunking.merge_blocks(blocks, policy) == groups
