"""A source tree from scan to answers."""

from fernweave.engine import Engine


def test_index_and_query(spark, tmp_path):
    tree = tmp_path / "tree"
    files = {
        "main.go": 'package main\nimport "github.com/x/log"\nfunc main() {\n\thelper()\n\tmissing()\n}\n', "util.go": "package main\nfunc helper() {\n\tdeep()\n}\nfunc deep() {}\n",
        "lib/a.h": "int area(int w);\n", "lib/a.c": '#include "a.h"\nint area(int w) {\n  return w;\n}\n',
    }
    for name, body in files.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(body)
    e = Engine(spark, str(tmp_path / "store"))
    first = e.index(str(tree), "r1", "demo")
    assert first.status == "success" and first.files == 4
    ids = {(r.name, r.kind): r.symbol_id for r in e.store.read("symbols").collect()}
    main, deep = ids["main", "function"], ids["deep", "function"]
    assert [r.name for r in e.callees(main).collect()] == ["helper"]
    assert [(r.name, r.depth) for r in e.transitive_callees(main).collect()] == [("helper", 1), ("deep", 2)]
    assert "- main" in e.impact(deep)
    kinds = {r.edge_type for r in e.store.read("edges").collect()}
    assert {"call", "import", "implements_header"} <= kinds
    assert e.search(["helper"], "keyword").first().entity_id == ids["helper", "function"]
    assert "helper" in e.ask(["helper function"]).first().prompt
    assert any('"metric":"dangling_edge_ratio"' in j for j in e.report("r1"))
    again = e.index(str(tree), "r1", "demo")
    assert again.files == 0
    (tree / "util.go").write_text("package main\nfunc helper() {}\n")
    assert e.index(str(tree), "r1", "demo").files == 1
    names = [r.name for r in e.store.read("symbols").collect()]
    assert "deep" not in names and names.count("helper") == 1
    assert e.repositories().first().name == "demo" and all(e.health()[t] for t in ("files", "symbols", "edges", "vectors"))
