"""The driver's contract file loads whatever optional packages are there."""

import subprocess
import sys

from tests.conftest import ROOT


def loaded(blocked: str) -> set[str]:
    code = f"import sys; sys.modules[{blocked!r}] = None; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(' '.join(e.queries()))"
    return set(subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True, timeout=120).stdout.split())


def test_a_missing_package_takes_no_other_query_away():
    keys = loaded("xxhash")
    assert len(keys) >= 100 and {"I6_fused", "S1_scan_project"} <= keys
    assert not any(k.startswith("op") for k in keys) and "pipeline" not in keys


def test_without_the_subpackage():
    assert loaded("kiln.llm") == loaded("kiln.llm.catalog") == {k for k in loaded("nothing_of_this_name") if not k.startswith("op") and k != "pipeline"}
