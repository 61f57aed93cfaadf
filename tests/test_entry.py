"""The entry without its optional part: the other queries and their SQL stay."""

import os
import shutil
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q))"


def test_entry_without_the_optional_package():
    top = tempfile.mkdtemp(prefix="entry-", dir="/tmp")
    for name in ("__spark_entry__.py", "oracle", "termloom"):
        src, dst = os.path.join(ROOT, name), os.path.join(top, name)
        if os.path.isdir(src):
            shutil.copytree(src, dst, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, dst)
    if os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):  # stays, and imports the package
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), top)
    got = subprocess.run([sys.executable, "-c", CODE], cwd=top, capture_output=True, text=True, check=True).stdout.split()
    assert int(got[0]) > 130 and int(got[1]) > 120 and got[2] == "False"
