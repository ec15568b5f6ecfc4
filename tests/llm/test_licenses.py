"""Against a brute-force scan of the base phrases, and templates with words put in and left out."""

import re

from weftgraph.llm import licenses
from weftgraph.llm.queries_licenses import op6_license_diagonals


def brute(text):
    w = re.findall(licenses.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def brute_method(text):
    """(labels, score) by trying every diagonal of every template."""
    w = re.findall(licenses.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [(label, 0.5) for p, label in licenses.PHRASES.items() if any(w[i : i + len(p.split())] == p.split() for i in range(len(w)))]
    for label, passage in licenses.TEMPLATES.items():
        t = passage.split()
        runs = len(t) - licenses.K + 1
        diagonals = {}
        for j in range(runs):
            for i in range(len(w) - licenses.K + 1):
                if w[i] == t[j] and w[i : i + licenses.K] == t[j : j + licenses.K]:
                    diagonals.setdefault(i - j, set()).add(j)
        before, places = None, set()
        for d in [*sorted(diagonals), None]:
            if places and (d is None or d - before > licenses.SLACK):
                if len(places) / runs >= licenses.COVERAGE:
                    found.append((label, len(places) / runs * (1 - 0.5 ** len(places))))
                places = set()
            before = d
            places |= diagonals.get(d, set())
    return ",".join(sorted({x for x, _ in found})), max((s for _, s in found), default=0.0)


MIT = " ".join(licenses.TEMPLATES["mit-text"].split())
TEXTS = [
    None, "", "...", "MIT", "Released under the MIT License.", "mit-license MIT LICENSE, apache\tlicense", "the GNU General Public License, version 3.", "É MIT Kelvin K license",
    MIT, MIT.replace("free of charge", "free of any charge").replace("merge publish ", ""), MIT[:150], "general public license " * 400, "Licensed under CC BY-NC 4.0.", "x " * 50_000 + "Licensed under the Apache License, Version 2.0.", "İMIT LİCENSE mit license",
]


def test_query(spark, tmp_path):
    rows = [(i, t, "k", 5) for i, t in enumerate(TEXTS)] + [(None, TEXTS[5], None, None), (3, "mit license", "k", 1), (3, "mit license", "k", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, key string, start int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_license_diagonals(spark, str(tmp_path)).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(str((i, *brute(t))) for i, t, *_ in rows)
    labels = {r.doc_id: (r.labels, r.score) for r in got}
    short = [t for t in TEXTS if len(t or "") < 20_000]
    assert all(labels[k] == brute_method(t) for k, t in enumerate(TEXTS) if t in short and k != 3)
    assert labels[8][0] == "mit-text" and 0.999 < labels[8][1] <= 1 and labels[5][1] == 0.5 and labels[9][0] == "mit-text" and 0.8 < labels[9][1] < 1
    assert labels[10] == ("", 0.0) and labels[12][0] == "cc-by-nc-4.0-notice"
    assert labels[13][0] == "apache,apache-2.0-notice" and labels[4][0] == "mit,mit-notice" and labels[6][0] == "gpl"
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op6_license_diagonals(spark, f"{tmp_path}/none").count() == 0


def test_equal_file_names_in_two_folders(spark, tmp_path):
    for folder, text in (("p=a", "released under the mit license"), ("p=b", "apache license apache license")):
        spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/new/{folder}")
        (tmp_path / "documents.parquet" / folder).mkdir(parents=True)
        next((tmp_path / "new" / folder).glob("part-*.parquet")).rename(tmp_path / "documents.parquet" / folder / "part-0.parquet")
    got = sorted((r.n_base, r.base_labels) for r in op6_license_diagonals(spark, str(tmp_path)).collect())
    assert got == [(1, "mit"), (2, "apache")]
