"""Rules that the source tree keeps."""

import re
from pathlib import Path

PACKAGE = Path(__file__).resolve().parent.parent / "graphloom"


def test_nothing_else_imports_the_corpus_operators():
    for path in PACKAGE.rglob("*.py"):
        if "llm" not in path.relative_to(PACKAGE).parts:
            assert not re.search(r"^\s*(?:from|import) graphloom\.llm", path.read_text(), re.M), path


def test_no_local_checkpoints():
    for path in PACKAGE.rglob("*.py"):
        assert "localCheckpoint(" not in path.read_text(), path
