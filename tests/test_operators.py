import pytest
from pyspark.sql import functions as F

from millrace.operators import chat, chunking, code, graph, search, tables, vectors
from millrace.sources import files

D1, D2 = "Hello\nWorld\n\nThis is a test\nof the text splitter.", "Another document\nwith some text\nto split."


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize(
    ("text", "size", "want"),
    [
        ("Hello World! This is a test of the text splitter.", 8, ["Hello Wo", "rld! Thi", "s is a t", "est of t", "he text ", "splitter", "."]),
        (D1, 10, ["Hello\nWorl", "d\n\nThis is", " a test\nof", " the text ", "splitter."]),
        (D2, 10, ["Another do", "cument\nwit", "h some tex", "t\nto split", "."]),
        ("", 4, []),
    ],
)
def test_split_by_count(spark, text, size, want):
    got = chunking.split_by_count(docs(spark, text), size).orderBy("idx").collect()
    assert [r.chunk_text for r in got] == want


def test_split_cuts_bytes(spark):
    got = [bytes(r.chunk_bytes).hex() for r in chunking.split_text(docs(spark, "héllo"), 2, separators=["x"]).orderBy("idx").collect()]
    assert got == ["68c3", "a96c", "6c6f"]
    with pytest.raises(ValueError):
        chunking.split_by_count(docs(spark, "a"), 0)


@pytest.mark.parametrize(
    ("text", "seps", "want"),
    [(D1, ["\n\n", "\n", " "], "Hello World This is a test of the text splitter.".split()), (D2, ["\n\n", "\n", " ", ""], ["Another", "document", "with", "some", "text", "to split."])],
)
def test_recursive_split(spark, text, seps, want):
    assert [r.chunk for r in chunking.recursive_split(docs(spark, text), seps, 10).orderBy("idx").collect()] == want
    if "" not in seps:
        assert [r.chunk for r in chunking.recursive_split_plain(docs(spark, text), seps, 10).orderBy("idx").collect()] == want
    assert chunking.split_recursive("a#b", ["#"], 1, keep=True) == ["a", "#", "b"]
    assert chunking.split_recursive("x\n## y", chunking.separators("MARKDOWN"), 3, regex=True) == ["x", "y"]


def test_overlap_and_languages(spark):
    c = spark.createDataFrame([(1, i, x) for i, x in enumerate([b"abcd", b"efgh", b"ij"])], "doc_id long, idx int, chunk_bytes binary")
    assert [bytes(r.chunk_bytes) for r in chunking.add_overlap(c, 3).orderBy("idx").collect()] == [b"abcdefg", b"efghij", b"ij"]
    for lang in "PYTHON GO HTML JS TS MARKDOWN JSON".split():
        assert chunking.separators(lang)
    with pytest.raises(ValueError):
        chunking.separators("INVALID")
    m = spark.createDataFrame([({"language": "COBOL"},), ({"file_type": ".py"},), ({},)], "m map<string,string>")
    assert [r[0] for r in m.select(chunking.language_of("m", strict=False)).collect()] == ["COBOL", "PYTHON", "DEFAULT"]
    with pytest.raises(Exception, match="unsupported language"):
        m.select(chunking.language_of("m")).collect()


def test_search(spark):
    d = docs(spark, "alpha beta gamma", "beta gamma", "gamma delta", "Alphabet soup", None)
    hits = lambda q: sorted(r.row_id for r in search.match(d, "doc_id", ["text"], q).collect())
    assert hits("alpha gamma") == [0] and hits("alpha OR delta") == [0, 2] and hits("alpha*") == [0, 3]
    assert hits('"beta gamma"') == [0, 1] and hits('"alpha gamma"') == [] and hits("") == []
    assert set(hits("beta gamma")) <= set(hits("beta OR gamma"))
    level, got = search.relax(d, "doc_id", {"text": 1.0}, ["beta", "nothing"], top_n=3)
    assert level == "or" and {r.row_id for r in got.collect()} == {0, 1}
    level, got = search.relax(d, "doc_id", {"text": 1.0}, ["gamma", "nothing"], top_n=3, accept="at_least")
    assert level == "and_1" and got.count() == 3
    level, got = search.relax(d, "doc_id", {"text": 1.0}, ["alph"], top_n=1)
    assert level == "prefix" and {r.row_id for r in got.collect()} == {0, 3}
    with pytest.raises(LookupError):
        search.relax(d, "doc_id", {"text": 1.0}, ["zzz"], top_n=3)
    s = search.bm25(d, "doc_id", {"text": 1.0}, ["gamma"])
    assert [r.row_id for r in search.top(s, 2).collect()] == [r.row_id for r in search.top(s, 3).collect()][:2]


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = vectors.knn(v, v.where("vec_id = 4"), 2).collect()
    assert [(r.query_id, r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(4, 3), (4, 2)]
    assert vectors.knn(v, v.limit(0), 2).count() == 0
    r = spark.createDataFrame([(["a", "b", "c"], [0.2, 0.5, 0.5])], "labels array<string>, scores array<double>")
    assert r.select(vectors.rank_labels()).first()[0] == ["b", "c", "a"]


def test_graph(spark):
    e = lambda *p: spark.createDataFrame(p, "src long, dst long")
    log = spark.createDataFrame([], tables.SCHEMAS["edge_log"])
    log = graph.add_edges(log, e((1, 2), (1, 3), (2, 3)), 1)
    log = graph.remove_edges(log, e((1, 2), (9, 9)), 2)
    near = lambda g, v, t=None: sorted(r.dst for r in graph.neighbors(g, v, t).collect())
    assert near(log, 1) == [3] and near(log, 1, 1) == [2, 3] and near(log, 7) == []
    assert [r.dst for r in graph.common_neighbors(log, 1, 2).collect()] == [3]
    assert graph.find_edge(log, 1, 2).first().is_deleted
    small = graph.collect_garbage(log, 10)
    assert small.count() == 2 and near(small, 1) == [3]
    assert near(graph.add_edges(log, e((1, 2)), 3), 1) == [2, 3]
    n = spark.createDataFrame([(0, "Person", {"n": "Alice"}), (1, "Movie", {"n": "M"})], tables.SCHEMAS["nodes"])
    assert [r.id for r in graph.match_label(n, "MATCH (p:Person) RETURN p").collect()] == [0]
    assert sorted(r.id for r in graph.add_nodes(n, n.select("type", "data")).collect()) == [0, 1, 2, 3]
    got = graph.reachable(e((1, 2), (2, 3), (3, 1), (5, 6)), spark.createDataFrame([(1,)], "id long"))
    assert sorted((r.id, r.depth) for r in got.collect()) == [(1, 0), (2, 1), (3, 2)]


SOURCE = '''package demo

import "fmt"

var limit, other int = 3, 4
const (
	a = 1
	b string = "func x("
)

// Foo does things.
// It calls.
func Foo(x, y int, z string) (int, error) {
	f(g(h()))
	fmt.Println("bar()")
	return 1, nil
}

func (s *Server) Run() error {
	Foo(1, 2, "")
	return nil
}
'''


def test_code(spark):
    f = spark.createDataFrame([("/a.go", SOURCE)], "path string, content string")
    fs = {r.name: r for r in code.extract(f, dedup=False).collect()}
    assert sorted(fs) == ["Foo", "Server.Run"]
    foo = fs["Foo"]
    assert foo.parameters == ["x int", "y int", "z string"] and foo.returns == ["int", "error"] and foo.line_number == 13
    assert foo.comments == "Foo does things.\nIt calls.\n" and foo.package == "demo" and foo.code.startswith("func Foo(") and foo.code.endswith("}")
    assert foo.calls == ["f", "g", "g", "h", "h", "h", "Println"] and foo.called_by == ["Server.Run"]
    assert {r.name: r.calls for r in code.extract(f).collect()}["Foo"] == ["f", "g", "h", "Println"]
    assert code.calls_in("demo.Foo()", ["demo"]) == ["demo.Foo"]
    v = {r.name: (r.type, r.scope) for r in code.variables(f).collect()}
    assert v == {"limit": ("int", "package"), "other": ("int", "package"), "a": ("unknown", "package"), "b": ("string", "package")}
    asked = lambda p: spark.range(1).select(code.asked_function(F.lit(p))).first()[0]
    assert asked("function SaveChatTurn") == asked("SaveChatTurn function") == "SaveChatTurn"
    assert asked("the function Foo") == "the" and asked("nothing here") is None
    rel = code.relationships(code.extract(f)).where("name = 'Foo' and direction = 'calls'").collect()
    assert {r.file_path for r in rel} == {"External/Unknown"}


def test_chat(spark):
    d = lambda c, r=None: '{"choices":[{"finish_reason":%s,"delta":{"content":"%s"}}]}' % ("null" if r is None else f'"{r}"', c)
    lines = [("t1", 0, "data: " + d("Hel")), ("t1", 1, ": ping"), ("t1", 2, "data: " + d("lo")), ("t1", 3, "data: " + d("", "stop")), ("t1", 4, "data: " + d("late")), ("t2", 0, "data: " + d("x")), ("t2", 1, "data: [DONE]"), ("t3", 0, "data: " + d("y")), ("t3", 1, "data: {broken"), ("t4", 0, "data: " + d("z"))]
    got = {r.id: (r.text, r.status) for r in chat.accumulate(spark.createDataFrame(lines, "id string, seq int, line string"), "id", "seq").collect()}
    assert got == {"t1": ("Hello", "complete"), "t2": ("x", "complete"), "t3": ("y", "error"), "t4": ("z", "open")}
    assert spark.range(1).select(chat.Tools().run(F.lit("p"))).first()[0] == "p"
    roles = spark.createDataFrame([(1, "b", "2"), (2, "a", "1")], tables.SCHEMAS["roles"])
    assert chat.role_map(roles).first().roles == {"a": "1", "b": "2"}


def test_tables(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", True), (2, "b", False)], tables.SCHEMAS["tools"])
    again = tables.upsert(tables.upsert(t, t, "id"), t, "id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, t.collect()))
    with pytest.raises(LookupError):
        tables.set_flag(t, F.col("id") == 9, "enabled", True)
    assert tables.update(t, F.col("id") == 1, name="", enabled=False).where("id = 1").first().asDict() == {"id": 1, "name": "a", "enabled": True}
    tables.create(spark, str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db/chats")).columns == ["id", "prompt", "response", "model_name", "embedding"]


def test_sources(spark, tmp_path):
    (tmp_path / "src/vendor").mkdir(parents=True)
    (tmp_path / "src/a.md").write_text("# hi")
    (tmp_path / "src/b.MD").write_text("no")
    (tmp_path / "src/c.go").write_text(SOURCE)
    (tmp_path / "src/vendor/d.go").write_text("package d")
    root = str(tmp_path / "src")
    got = {r.metadata["source"]: r.page_content for r in files.text_documents(spark, root).collect()}
    assert sorted(got) == ["a.md", "c.go", "vendor/d.go"] and got["a.md"] == "# hi"
    assert files.go_files(spark, root).count() == 1
    assert files.typed_files(spark, [root], [".md"], ignore=["b."]).count() == 1
    (tmp_path / "e.json").write_text('{"w": {"Word": "w", "Vector": [1.0, 2.0], "Similarity": 0.5}}')
    assert files.embeddings_json(spark, str(tmp_path / "e.json")).first().vector == [1.0, 2.0]
    body = F.lit('{"data":[{"index":1,"embedding":[3.0]},{"index":0,"embedding":[1.0,2.0]}]}')
    assert spark.range(1).select(files.embedding_response(body)).first()[0] == [1.0, 2.0, 3.0]
    e = files.embedded(spark.createDataFrame([("ab",), ("c",)], "t string"), "t", lambda ts: [[float(len(x))] * 4 for x in ts], size=4)
    assert sorted(r.vector[0] for r in e.collect()) == [1.0, 2.0]
    p = spark.createDataFrame([("x.pdf", 2, "two"), ("x.pdf", 1, "ONE")], "path string, page int, text string")
    assert files.pdf_documents(p).first().page_content == "## ONE\n\ntwo\n\n"


def test_concatenation(spark, tmp_path):
    rows = [(g, i, None if i % 7 == 0 else f"{g}é{i}\n\n") for g in ("a", None, "b") for i in range(60 if g == "a" else 9)] + [("a", 5, "")]
    got = tables.concat_ordered(spark.createDataFrame(rows, "g string, i int, t string"), "g", "i", "t").collect()
    assert len(got) == len(rows)
    for g in ("a", None, "b"):
        at = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: (r.i, r.t)):
            assert r.at == at
            at += len(r.t.encode())
    parts = tables.concat_ordered(spark.createDataFrame(rows, "g string, i int, t string"), "g", "i", "t")
    files.write_concat(parts, "g", "t", f"{tmp_path}/out")
    whole = "".join(f.read_text() for f in sorted((tmp_path / "out" / "g=a").glob("part-*")))
    assert whole == "".join(f"aé{i}\n\n" for i in range(60) if i % 7)


def test_callers_are_rows(spark):
    f = spark.createDataFrame([(f"f{i}", ["f0", "print"]) for i in range(20)], "name string, calls array<string>")
    assert sorted(r.caller for r in code.callers(f).collect()) == sorted(f"f{i}" for i in range(20))
    assert {(r.name, r.total_called_by) for r in code.counts(f).collect()} == {("f0", 20)} | {(f"f{i}", 0) for i in range(1, 20)}


def test_recursive_split_takes_a_batch_in_parts(spark):
    texts = [None if i % 50 == 7 else "ab, cd. " * (i % 9) + "x" * i for i in range(3 * chunking.SPLIT_ROWS + 5)]
    got = chunking.recursive_split(docs(spark, *texts).coalesce(1), [", ", ". "], 10)
    want = [(i, j, c) for i, t in enumerate(texts) if t is not None for j, c in enumerate(chunking.split_recursive(t, [", ", ". "], 10))]
    assert sorted(map(tuple, got.select("doc_id", "idx", "chunk").collect())) == want


def test_postings_of_a_row_are_stored_in_one_file(spark, tmp_path, monkeypatch):
    """Postings are not shuffled: texts are, once, by row."""
    monkeypatch.setattr(search, "FILE_BYTES", 500)
    d = docs(spark, *(f"the word w{i} " * (1 + i % 5) for i in range(60)), None)
    search.store(d, "doc_id", {"text": 1.0}, str(tmp_path / "i"))
    p = spark.read.parquet(str(tmp_path / "i" / "postings")).withColumn("file", F.input_file_name())
    assert p.select("file").distinct().count() > 2 and p.select("row_id", "file").distinct().count() == 60
    key = lambda df: sorted((r.row_id, round(r.score, 9)) for r in df.collect())
    assert key(search.stored(spark, str(tmp_path / "i"), ["word", "w7"])) == key(search.bm25(d, "doc_id", {"text": 1.0}, ["word", "w7"]))
