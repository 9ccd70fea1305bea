"""Texts are read in pieces, each once; single results are made without tables."""

import random

import pytest

from fidelis.operators import fidelity, reading
from fidelis.plans import durable, queries

ODD = ["。", "；", "，", ", ", ". ", ".\n", " ", "\n", "(", "（", ")", "）", "[", "]", "A", "Smith", "et al", "2019", "1998", "Mar", "doi: ", "10.1234/x.5", "https://a.b/c", "5", "12", "1,000", "%", "万元", "家", "Firms", "p", "<", "0.5", "of", "ROA", "ROA", "王明", "“", "”", "percent", "-", "至", "年"]


def whole(text: str) -> list[reading.Fact]:
    """The facts of a text that is read in one piece."""
    claimed, out = bytearray(len(text)), []
    for one in reading._PASSES:
        reading._claim(reading._matches(text, *one), claimed, out)
    places: dict[str, list[int]] = {}
    for m in reading._VARIABLE.finditer(text):
        places.setdefault(m[0], []).append(m.start())
    reading._claim(reading._variables(places, claimed), claimed, out)
    reading._claim(reading._matches(text, *reading._QUOTED), claimed, out)
    first = {}
    for fact in sorted(out, key=lambda f: f.start):
        first.setdefault((fact.kind, fact.canonical), fact)
    return list(first.values())


def test_pieces_give_the_facts_of_the_whole_text():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(2, 14)))
        assert reading.facts(text) == whole(text), text
    for text in ("See J. Smith (2019). It holds.", "It held (J. Smith, 2019). So.", "占比，0.5。[1，\n2]", "It took 1, 万元. In Mar. 2019 too."):
        assert reading.facts(text) == whole(text)


def test_a_sentence_of_both_texts_is_read_once(monkeypatch):
    read = []
    matches = reading._matches
    monkeypatch.setattr(reading, "_matches", lambda text, *one: read.append(text) or matches(text, *one))
    old = "另查了512家。" + "又占比为34%，" * 20 + "完。"
    fidelity._compared(old, old.replace("512", "519"), [], None)
    assert sum(map(len, read)) < 2 * len(reading._PASSES) * len(old) / 4


def test_rates_of_texts_alone(spark):
    old = spark.createDataFrame([(1, "查了512家[3]。占比为34%。", ["网络"]), (2, "", []), (3, "网络。在5%水平上显著。", ["网络"])], "doc_id long, text string, glossary array<string>")
    new = spark.createDataFrame([(1, "查了519家[3]。占比为0.34。"), (3, "p<0.05。")], "doc_id long, text string")
    lock = spark.createDataFrame([(1, 1, "m001", "number", "7 千", "NUM(7)", "", -1, -1), (1, 2, "m002", "count", "519家", "COUNT(519)", "", -1, -1)], "doc_id long, seq int, atom_id string, kind string, surface string, canonical string, context string, start int, end int")
    for locked in (None, lock):
        both = [sorted(fidelity.Check(old, new, locked, kept=kept).rates().collect()) for kept in (True, False)]
        assert both[0] == both[1]


@pytest.mark.parametrize("name", ["preserved_rate", "gate_long_numbers", "validate_summaries"])
def test_a_single_result_writes_no_table(spark, name):
    made = len(durable._MADE)
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns[0] == "doc_id"
    assert len(durable._MADE) == made


def test_percentages_of_documents_as_written(spark, tmp_path):
    """A percentage ending in 0 after its point, beside the same value written shorter, and words that repeat."""
    import duckdb

    texts = ["Hosts 126.57.31.30%%% and 1.0%%% here.", "It fell by 31.3%, then 31.30% and 031.3 % or 0.50％, at 007%, of ABCDEFGH and ABCDEFGH.", "ABCDEFGH 5%", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    want = duckdb.connect().execute(queries.ORACLES["atoms_documents"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in queries.QUERIES["atoms_documents"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and (0, "percent", "PCT(31.30)") in got


@pytest.mark.parametrize("name", ["gate", "model_lock_gate", "mutation_matrix", "verdicts", "rule_coverage"])
def test_a_gate_is_told_of_the_texts_alone(spark, name):
    """No table of all facts is written, and none is handed over: what leaves Python is the result."""
    made = len(durable._MADE)
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(durable._MADE) == made and "results#" not in plan and "lock#" not in plan and "locked#" not in plan.replace("atoms_locked#", "")


def test_texts_that_come_back_are_kept():
    """Pieces that occur once don't drive out those that are asked for again and again."""
    made = []
    kept = reading._Kept(lambda text: made.append(text) or (text,), 8)
    for i in range(100):
        assert kept["common"] == ("common",) and kept[f"once {i}"] == (f"once {i}",)
    assert made.count("common") == 1
