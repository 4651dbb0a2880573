"""Whole jobs over a small file, and the driver's contract."""

import json
import os

import __spark_entry__ as entry
from dialoom.functions.rules import DEFAULT, load_pack
from dialoom.plans import catalogue, jobs
from dialoom.session import cut, drop_cuts
from dialoom.sources import writers


def lines(n=60):
    out = []
    for i in range(n):
        turns = f"您好，请问退款多久到账呢？订单{i % 30}"
        out.append(f"1\t{turns}\t退款一般{i % 5 + 2}天内到账的，已经帮您登记退款{i % 30}了")
        out.append(f"0\t{turns}\t这个问题不清楚，您看着办吧{i % 30}")
    return "\n".join(out) + "\n"


def test_jobs(spark, tmp_path):
    (tmp_path / "raw.txt").write_text(lines(), encoding="utf-8")
    picked = jobs.select_pairs(spark, str(tmp_path / "raw.txt"), str(tmp_path / "sel"), 20)
    assert 0 < picked.count() <= 20
    counters = spark.read.json(str(tmp_path / "sel/counters")).first()
    assert counters.label_1 + counters.label_0 + counters.parse_failed == counters.total_lines == 120
    assert spark.read.text(str(tmp_path / "sel/pairs")).count() == 2 * picked.count()
    kept = jobs.convert_job(spark, str(tmp_path / "raw.txt"), str(tmp_path / "conv"), 1)
    assert kept.count() == 60 and spark.read.json(str(tmp_path / "conv/messages")).count() == 60
    done = jobs.repair_job(spark, str(tmp_path / "raw.txt"), str(tmp_path / "rep"), targets=(5,))
    assert done[5].count() == 5
    preview = [json.dumps({"score": float(i), "category": "abc"[i % 3], "context": ["a"], "chosen": f"c{i}", "rejected": "r"}) for i in range(30)]
    (tmp_path / "preview.jsonl").write_text("\n".join(preview))
    assert {r.split: r["count"] for r in jobs.split_job(spark, str(tmp_path / "preview.jsonl"), str(tmp_path / "spl")).groupBy("split").count().collect()} == {"train": 18, "dev": 6, "test": 6}
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"instruction": "i", "input": f"x{i % 8}", "output": "y"}) for i in range(20)))
    assert jobs.prepare_job(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "prep"), 0.25).where("is_validation").count() == 2


def test_contract():
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 60
    assert set(catalogue.queries()) <= set(known)


def test_core_does_not_import_llm():
    from pathlib import Path

    root = Path(catalogue.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "dialoom.llm" not in path.read_text(encoding="utf-8"), path


def test_more_jobs(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"results": [{"id": i, "prediction": "好的" * i, "reference": "好的"} for i in range(4)]}))
    jobs.main(["evaluate", str(tmp_path / "p.json"), str(tmp_path / "ev"), "--worst", "2"])
    assert spark.read.json(str(tmp_path / "ev/worst")).count() == 2 and spark.read.json(str(tmp_path / "ev/means")).first().rows == 4
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps({"instruction": "i", "input": f"x{i}", "chosen": "c", "rejected": "r"}) for i in range(20)))
    assert jobs.noise_job(spark, str(tmp_path / "d.jsonl"), str(tmp_path / "noise"), 0.25).where("noise_swapped").count() == 5
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"instruction": "i", "input": f"x{i}", "output": "补偿" if i == 3 else "y"}) for i in range(6)))
    (tmp_path / "m.jsonl").write_text(json.dumps({"instruction": "i", "input": "new", "output": "z"}))
    done = jobs.replace_job(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "rp"), str(tmp_path / "m.jsonl"))
    assert sorted(r.input for r in done.collect()) == ["new", "x0", "x1", "x2", "x4", "x5"]
    (tmp_path / "t.csv").write_text("timestamp,index,name,memory_used_mb,memory_total_mb,utilization_gpu_pct,power_draw_w\n" + "\n".join(f"t,0,n,{m},9,9,9" for m in (1, 5, "x")))
    assert jobs.telemetry_job(spark, str(tmp_path / "t.csv"), str(tmp_path / "tel")).first().peak_mb == 5
    pack = load_pack('{"blocked": ["foo"], "risks": [["bar", 1.0]]}')
    assert pack.blocked == ("foo",) and pack.risks == (("bar", 1.0),) and pack.soft == DEFAULT.soft


def test_cuts_are_dropped(spark):
    df = cut(spark.range(3))
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and drop_cuts(spark) >= 1 and not os.path.exists(path)
    assert writers.backup(spark, ["/nowhere"], "/tmp/x", "s") == "/tmp/x/backup_s"
