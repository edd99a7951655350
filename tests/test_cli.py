import json

from plumbline.__main__ import main
from plumbline.checks import load


def test_profile_drafts_run_history(spark, tmp_path, capsys):
    spark.sql("SELECT id AS VisitKey, id % 4 AS practice, IF(id % 3 = 0, NULL, 'x') AS status, 0 AS is_deleted FROM range(40)").write.parquet(f"{tmp_path}/v")
    base = ["--views", f"app.visits={tmp_path}/v", "--state", f"{tmp_path}/state", "--as-of", "2024-06-30"]
    assert main(["profile", *base]) == 0 and (tmp_path / "state/catalog-v1.md").exists()
    main(["drafts", *base])
    docs = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert [d["id"] for d in docs] == ["visits-visit-key-zero-or-negative-id", "visits-visit-key-duplicate"]
    (tmp_path / "check.json").write_text(json.dumps(docs[0]))
    main(["run", *base, "--checks", str(tmp_path / "check.json"), "--run-id", "r1"])
    assert "| visits-visit-key-zero-or-negative-id | 0 | 10 | 1 | 9 | 0 |" in capsys.readouterr().out
    main(["history", *base])
    assert "created" in capsys.readouterr().out and (tmp_path / "state/audit.jsonl").exists()


def test_packaged_documents_load():
    assert load("invoice-negative-total").view == "clinic.invoices"
