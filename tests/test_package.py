"""The package away from its folder, and the library without its optional subpackage."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code, cwd, path):
    env = {**os.environ, "PYTHONPATH": ""}
    code = f"import sys; sys.path.insert(0, {path!r})\n{code}"
    return subprocess.run([sys.executable, "-c", code], cwd=cwd, env=env, capture_output=True, text=True, timeout=240)


def test_workers_find_the_package_from_another_folder(tmp_path):
    done = run(
        "from codelineage.session import build_session\nimport __spark_entry__ as e\n"
        "s = build_session('local[2]')\nprint('ROWS', e.queries()['parse_modes'](s, '/root/testdata/sf0.001').count())\n"
        "from pyspark.sql import functions as F\nfrom codelineage.functions.pycode import parse_info\n"
        "print('MODE', s.createDataFrame([('x = 1',)], 'c string').select(parse_info(F.col('c'))['mode']).first()[0])",
        tmp_path, REPO,
    )
    assert "MODE module" in done.stdout, done.stderr[-2000:]


def test_entry_without_the_optional_part(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "*.json", "*.md")
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=skip)
    done = run("import __spark_entry__ as e\nq = e.queries()\nprint('N', len(q), 'pipeline' in q, any(k.startswith('op') for k in q), set(e.oracle_sql()) <= set(q))", tmp_path, str(copy))
    n, *flags = done.stdout.split()[1:]
    assert int(n) > 150 and flags == ["False", "False", "True"], done.stderr[-2000:]
