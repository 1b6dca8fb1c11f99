"""The command line, in this process."""

import json

import pytest
from test_analysis import FILES

from stratagraph.__main__ import main


@pytest.fixture
def shop(spark, tmp_path):
    for svc in ("services/auth", "."):
        for name, text in FILES.items():
            p = tmp_path / svc / name
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(text)
    return tmp_path


def test_verbs(shop, capsys, monkeypatch):
    monkeypatch.chdir(shop)
    at = str(shop / "domain")
    assert main(["init"]) == 0 and main(["init"]) == 2 and main(["analyze", str(shop / "nowhere")]) == 2
    assert main(["analyze", at, "--format", "json", "--compact"]) == 0
    assert "repo" in json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert main(["check", str(shop), "--fail-on", "warn", "--track"]) == 1
    assert main(["check", str(shop), "--ignore", "L001,L003", "--no-regression", "--incremental"]) == 0 and "PASSED" in capsys.readouterr().out
    assert main(["check", str(shop), "--ignore", "L001", "--package-cycles", "--incremental", "--format", "markdown"]) == 1
    out = capsys.readouterr().out
    assert "# Check failed" in out and "D001" in out and "circular_dependency" in out
    assert main(["check", str(shop), "--per-service", "--ignore", "L001", "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["passed"]
    assert main(["diagram", at, "--format", "dot"]) == 0 and "digraph" in capsys.readouterr().out
    assert main(["forensics", at, "--output", str(shop / "f.md")]) == 0 and "# Forensics" in (shop / "f.md").read_text()
    assert main(["forensics", at, "--project-root", str(shop)]) == 0 and "domain/bad.go" in capsys.readouterr().out
    assert main(["analyze", str(shop), "--per-service"]) == 0 and "services/auth" in capsys.readouterr().out
