"""Turtle by hand-made files."""

import pytest

from weftgraph.sources.turtle import RDF, File, turtle

TEXT = """@prefix ex: <http://x.org/> . # a comment
PREFIX : <http://y.org/>
@base <http://base.org/> .
ex:ann a ex:Person ; ex:name "Ann \\"A\\" \\u00e9"@en, 'Anna' ; ex:age 41 ; ex:ok true ;; :height "1.70"^^<http://t/decimal> .
<bob> ex:knows ex:ann, [ ex:name "anon" ; a ex:Person ], _:z1 .
_:z1 ex:list (1 ex:ann) ; ex:note \"\"\"two
"lines\"\"\" .
ex:a.b ex:e -1.5e3 .
[] ex:p ex:q .
"""


def test_triples():
    got = list(File(TEXT).triples())
    x, y = "http://x.org/", "http://y.org/"
    assert got[:7] == [
        (x + "ann", RDF + "type", x + "Person", None), (x + "ann", x + "name", None, 'Ann "A" é'), (x + "ann", x + "name", None, "Anna"), (x + "ann", x + "age", None, "41"),
        (x + "ann", x + "ok", None, "true"), (x + "ann", y + "height", None, "1.70"), ("http://base.org/bob", x + "knows", x + "ann", None),
    ]
    assert set(got[7:11]) == {("_:b1", x + "name", None, "anon"), ("_:b1", RDF + "type", x + "Person", None), ("http://base.org/bob", x + "knows", "_:b1", None), ("http://base.org/bob", x + "knows", "_:z1", None)}
    assert set(got[11:17]) == {("_:b2", RDF + "first", None, "1"), ("_:b2", RDF + "rest", "_:b3", None), ("_:b3", RDF + "first", x + "ann", None), ("_:b3", RDF + "rest", RDF + "nil", None), ("_:z1", x + "list", "_:b2", None), ("_:z1", x + "note", None, 'two\n"lines')}
    assert got[17:] == [(x + "a.b", x + "e", None, "-1.5e3"), ("_:b4", x + "p", x + "q", None)]
    assert list(File("").triples()) == list(File("# only\n").triples()) == []


@pytest.mark.parametrize("bad", ["ex:a ex:b ex:c .", "<a> <b> <c>", "<a> <b> .", '"x" <b> <c> .', "<a> <b> { .", "<a> <b> <c> , ."])
def test_what_cant_be_read(bad):
    with pytest.raises(ValueError):
        list(File(bad).triples())


def test_files(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("<s:a> <p:b> _:x .")
    (tmp_path / "b.ttl").write_text("_:x <p:b> 'lit' .")
    (tmp_path / "c.ttl").write_text("")
    assert sorted(map(tuple, turtle(spark, str(tmp_path)).collect())) == [("_:b.ttl/x", "p:b", None, "lit"), ("s:a", "p:b", "_:a.ttl/x", None)]
