from __future__ import annotations

import pytest

from corpusloom.__main__ import main
from corpusloom.operators import vectors
from corpusloom.sources.files import read_tree


def test_commands(spark, tmp_path, capsys):
    tree = tmp_path / "tree"
    (tree / "app").mkdir(parents=True)
    (tree / "app" / "a.py").write_text("def parse_line(x):\n    return split_words(x)\n\n\ndef split_words(x):\n    return x\n")
    (tree / "gone.py").write_text("x = 1\n")
    (tree / ".gitignore").write_text("gone.py\n")
    assert sorted(r.path for r in read_tree(spark, str(tree)).select("path").collect()) == ["app/a.py", "gone.py"]
    assert sorted(r.path for r in read_tree(spark, str(tree), tracked=True).select("path").collect()) == ["app/a.py"]
    at = ["--index", str(tmp_path / "ix")]
    assert main([*at, "--embedder", "mock", "index", str(tree)], spark) == 0
    assert "generation 1, 1 files" in capsys.readouterr().out
    assert main([*at, "callers", "split_words", "--depth", "2"], spark) == 0
    assert "app.a.parse_line" in capsys.readouterr().out
    assert main([*at, "status"], spark) == 0
    assert "files: 1" in capsys.readouterr().out


def test_choice_of_embedder():
    def broken():
        raise OSError("no model here")

    assert vectors.embedder("none") is None and vectors.embedder("mock") is vectors.HashEmbedder and vectors.embedder(broken) is None
    with pytest.raises(ValueError):
        vectors.embedder("other")
