"""Command line on a small repository."""

import json

from test_engine import FILES

from loomctx.cli import main


def test_commands(spark, tmp_path, capsys):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    run = lambda *a: (main(["--repo", str(tmp_path), *a]), capsys.readouterr().out)
    assert run("doctor")[0] == 2 and run("status")[0] == 2
    assert run("init", str(tmp_path))[0] == 0 and (tmp_path / ".loomctx" / "config.toml").exists()
    assert json.loads(run("index")[1])["files_indexed"] == 4
    assert run("doctor")[0] == 0
    assert any(h["symbol"] == "process_payment" for h in json.loads(run("search", "process_payment", "--json")[1]))
    packed = json.loads(run("pack", "process_payment", "--json", "--budget", "500", "--no-content")[1])
    assert packed["totals"]["selected_tokens"] <= 500 and all("content" not in i for i in packed["items"])
    assert json.loads(run("why", packed["pack_id"])[1])["query"] == "process_payment" and run("why", "none")[0] == 1
    assert run("pack", "x", "--mode", "yolo")[0] == 1
    code, text = run("pack", "process_payment", "--render", "chat", "--copy")
    assert code == 0 and json.loads(text)["prompt_cache_key"].startswith("loom-")
    assert json.loads(run("callers", "PaymentValidator")[1]) and json.loads(run("pr-context", "--json")[1])["changed_files"] == []
    page = tmp_path / "demo.html"
    assert run("demo", str(tmp_path), "--out", str(page))[0] == 0
    html = page.read_text()
    assert "__DATA__" not in html and "process_payment" in html


def test_cache_stability(spark, tmp_path):
    from loomctx.plans.engine import Engine

    for name, text in FILES.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(text)
    got = Engine(spark, str(tmp_path / "r")).bench_cache_stability(str(tmp_path / "copy"))
    assert (got["stable"], got["of"], got["min_preservation_pct"]) == (3, 3, 100.0)
