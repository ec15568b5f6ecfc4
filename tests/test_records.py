"""Formats told from the files themselves."""

from weftgraph.sources import records


def test_formats(spark, tmp_path):
    files = {
        "a.csv": "id;name;price;sku\n1;\"x;y\";2.5;s\n2;;3;t\n", "b.txt": "status\tpriority\nopen\t1\n", "c.json": '[{"id": 1, "title": "one", "n": null},\n {"other": [1, 2]}]',
        "d.jsonl": '{"name": "p", "email": "e", "phone": "1"}\n\n{"name": "q"}\n', "e.txt": '{not json\n', "f.txt": "", "g.txt": "  \n", "h.csv": "id;name;price;sku\n3;z;1;u\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    kinds = {r.file.rsplit("/", 1)[1]: (r.format, r.delimiter) for r in records.sniffed(spark, str(tmp_path)).collect()}
    assert kinds == {"a.csv": ("csv", ";"), "b.txt": ("csv", "\t"), "c.json": ("json_array", None), "d.jsonl": ("jsonl", None), "e.txt": ("csv", ","), "h.csv": ("csv", ";")}
    got = sorted((r.file.rsplit("/", 1)[1], r.record_type, r.content) for r in records.read_records(spark, str(tmp_path)).collect())
    assert got == [
        ("a.csv", "Product", "id: 1; name: x;y; price: 2.5; sku: s"), ("a.csv", "Product", "id: 2; name: None; price: 3; sku: t"), ("b.txt", "Issue", "status: open; priority: 1"),
        ("c.json", "", "id: 1; title: one; n: None"), ("c.json", "", "other: [1,2]"), ("d.jsonl", "", "name: q"), ("d.jsonl", "Person", "name: p; email: e; phone: 1"),
        ("h.csv", "Product", "id: 3; name: z; price: 1; sku: u"),
    ]


def test_no_files(spark, tmp_path):
    (tmp_path / "x.txt").write_text("")
    assert records.read_records(spark, str(tmp_path)).count() == 0
