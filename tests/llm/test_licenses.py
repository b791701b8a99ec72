import pytest

from sorrel.llm import licenses
from sorrel.llm.queries import QUERIES
from tests_llm_common import SF, rows


@pytest.fixture(scope="module")
def model(documents):
    return licenses.fit(documents)


def scanned(spark, texts, model):
    df = spark.createDataFrame([(n, t, "x", 1) for n, t in enumerate(texts)], "doc_id int, text string, family string, probability int")
    return {(r["doc_id"], r["paragraph"]): r for r in rows(licenses.scan(df, model=model))}


def test_templates_and_notices_never_seen(spark, model):
    texts = [t for x in licenses.TEMPLATES.values() for t in x]
    families = [c for c, x in licenses.TEMPLATES.items() for _ in x]
    got = scanned(spark, texts, model)
    right = sum((n, 0) in got and got[n, 0]["family"] == c and got[n, 0]["confirmed"] for n, c in enumerate(families))
    assert right >= 0.9 * len(texts)
    new = {
        "All source code in this package is released under the MIT License.": "mit",
        "You may use this under the Apache License, Version 2.0, only": "apache",
        "this data is licensed under CC BY-NC 4.0.": "cc-by-nc",
        "The module is licensed under the GNU General Public License, version 3.": "gpl",
    }
    got = scanned(spark, list(new), model)
    assert [got[n, 0]["family"] for n in range(len(new))] == list(new.values())


def test_other_notices_are_never_confirmed_and_prose_is_left_alone(spark, model):
    prose = [
        "The permission of her parents was free of charge.", "A general public of two or three hundred people came under the tree.", "version 2",
        "We read about the public domain of the city and its license plates.", "der und die", "Thstinnt thndhain. Onhalyti the in erthst orth it",
    ]
    got = scanned(spark, [*licenses.OTHERS, *prose], model)
    assert not any(r["confirmed"] for r in got.values())


def test_odd_rows(spark, odd, no_documents, model):
    assert licenses.scan(odd, model=model).count() == 0
    assert licenses.scan(no_documents, model=model).count() == 0
    assert licenses.scan(no_documents).count() == 0
    notice = "Released under the MIT License."
    texts = [f"the onion of the sting {'thonand ' * 50_000}\n\n{notice}\nmore", notice, notice, None, "", "\n\n"]
    got = scanned(spark, texts, model)
    assert {k for k, r in got.items() if r["family"] == "mit" and r["confirmed"]} == {(0, 2), (1, 0), (2, 0)}


def test_plan_is_native(documents, model):
    plan = licenses.scan(documents, model=model)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_query_finds_every_notice_of_the_corpus(spark, documents):
    notices = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit",
    }
    want = {(r["doc_id"], n, notices[p]) for r in documents.collect() for n, p in enumerate(r["text"].split("\n")) if p in notices}
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in rows(QUERIES["op5_license_scan"](spark, SF)) if r["confirmed"]}
    assert want and got == want


@pytest.mark.parametrize("columns", [72, 50])
def test_notices_broken_into_lines(spark, model, columns):
    import textwrap

    told = [(c, t) for c, x in licenses.TEMPLATES.items() for t in x if len(t) > columns and "http" not in t]
    texts = [f"some words of prose\n\n{textwrap.fill(t, columns)}\n\nthe end of it" for _, t in told]
    got = scanned(spark, texts, model)
    missed = [t for n, (c, t) in enumerate(told) if not any(r["confirmed"] and r["family"] == c for k, r in got.items() if k[0] == n)]
    assert len(told) > 10 and not missed


def test_a_run_stands_for_its_lines_unless_one_is_confirmed(spark, model):
    mit = licenses.TEMPLATES["mit"][2]
    half = mit.index("of this software")
    got = scanned(spark, [f"{mit[:half]}\n{mit[half:]}", f"Released under the MIT License.\n{mit[:half]}\n{mit[half:]}"], model)
    assert [(k, r["lines"]) for k, r in sorted(got.items()) if k[0] == 0] == [((0, 0), 2)]
    assert (1, 0) in got and all(r["lines"] == 1 for k, r in got.items() if k[0] == 1)
