import json

from lexweave.plans import cli, quality, statistics
from lexweave.plans.generate import records, rules
from lexweave.plans.spec import Params
from lexweave.sources import sinks, text


def test_records_and_rules(spark, tmp_path):
    (tmp_path / "r.txt").write_text("A  b\tc \n\n x\n")
    (tmp_path / "rules.txt").write_text("a b, C d\nx, y, ignored\nno rule\n")
    got = [(r.id, r.toks) for r in text.read_records(spark, str(tmp_path / "r.txt")).orderBy("id").collect()]
    assert got == [(0, ["a", "b", "c"]), (1, [""]), (2, ["", "x"])]
    assert [(r.rule_id, r.lhs, r.rhs) for r in text.read_rules(spark, str(tmp_path / "rules.txt")).orderBy("rule_id").collect()] == [(0, ["a", "b"], ["c", "d"]), (1, ["x"], ["y"])]


def test_command_line(spark, tmp_path):
    (tmp_path / "r.txt").write_text("a b\nx b\nc\n")
    (tmp_path / "rules.txt").write_text("a b, c\na, x\n")
    (tmp_path / "truth.txt").write_text("0 1\n0 2\n1 2\n")
    p = str(tmp_path)
    out = cli.main(["-rulePath", f"{p}/rules.txt", "-dataOnePath", f"{p}/r.txt", "-dataTwoPath", f"{p}/r.txt", "-outputPath", f"{p}/out", "-algorithm", "JoinMH", "-additional", "-K 2 -qSize 2", "-groundPath", f"{p}/truth.txt", "-statPath", f"{p}/stat.json"])
    assert out["Output"]["pairs"] == 5 and out["Quality"]["tp"] == 2 and out["Quality"]["fn"] == 1 and out["Quality"]["fp"] == 0
    lines = [r.value for r in spark.read.text(f"{p}/out").collect()]
    assert "5" in lines and "a b (0)\t==\tx b (1)" in lines and len(lines) == 3
    assert json.loads((tmp_path / "stat.json").read_text())["Algorithm"] == "JoinMH"


def test_statistics_sinks(tmp_path):
    f = str(tmp_path / "s.txt")
    sinks.append_columns(f, {"a": 1})
    sinks.append_columns(f, {"a": 2})
    sinks.append_columns(f, {"a": 3, "b": 4})
    assert (tmp_path / "s.txt").read_text().splitlines() == ["# 1:a", "1", "2", "# 1:a 2:b", "3 4"]
    assert sinks.merge_stats({"n": 1, "Mem_x": 5, "alg": "A", "Param_k": 1}, {"n": 2, "Mem_x": 4, "alg": "B", "Param_k": 2}) == {"n": 3, "Mem_x": 5, "alg": "A", "Param_k": 1}
    sinks.write_json_map(f, {"a": "1"})
    assert sinks.read_json_map(f) == {"a": "1"}


def test_params():
    p = Params.parse("-K 2 -qSize 3 -delta 1 -dist lcs -verify GR4 -useLF false -sampleH 0.1")
    assert (p.k, p.q, p.delta, p.dist, p.check, p.beam, p.use_lf, p.sample_plan) == (2, 3, 1, "lcs", "beam", 4, False, 0.1)
    for bad in ("-K 0", "-dist hamming", "-theta 2", "-verify TD", "-nothing 1"):
        try:
            Params.parse(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_generators_repeat_and_plant(spark):
    a, b = ([(r.id, r.raw) for r in records(spark, 200, 50, rule_sides=[["t1", "t2"]], rules_per_record=1.0, equivalent=0.3).repartition(n).orderBy("id").collect()] for n in (1, 5))
    assert a == b and all("t1 t2" in x for _, x in a) and len({x for _, x in a}) < 190
    assert all(r.lhs != r.rhs for r in rules(spark, 50, 10).collect())


def test_quality_and_statistics(spark):
    found = spark.createDataFrame([(1, 1), (1, 2), (3, 4)], "id1 long, id2 long")
    truth = spark.createDataFrame([(1, 2), (5, 6)], "id1 long, id2 long")
    r = quality.scores(*quality.confusion(found, truth, self_join=True)).first()
    assert (r.tp, r.fn, r.fp, r.precision, r.recall, r.f1) == (1, 1, 1, 0.5, 0.5, 0.5)
    d = text.with_tokens(spark.createDataFrame([(0, "a b"), (1, "b")], "id long, raw string"))
    s = statistics.dataset(d).first()
    assert (s.records, s.tokens, s.max_len, s.distinct_tokens) == (2, 3, 2, 2)
