import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_llm_imports_it():
    for p in (ROOT / "readloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p
