"""Task-side code must not depend on the workers' import path."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_python_tasks_run_from_outside_the_repo(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})          # driver only; workers never see it
        from cootensor.session import get_session
        from cootensor import operators as op
        from cootensor.plans.solve import ridge_solve, leading_eigvecs
        spark = get_session("local[2]", shuffle_partitions=2)
        t = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (1, 1, 3.0)], "a int, b int, product double")
        g = {{(r._1, r._2): r.product for r in op.gram(op.unfold(t, "a")).collect()}}
        assert g == {{(0, 0): 1.0, (0, 1): 2.0, (1, 0): 2.0, (1, 1): 13.0}}, g
        assert leading_eigvecs(op.unfold(t, "a"), 1).count() == 2
        a = spark.createDataFrame([(0, 0, 2.0), (1, 1, 4.0)], "_1 int, _2 int, product double")
        c = spark.createDataFrame([(0, 0, 2.0), (0, 1, 8.0)], "_1 int, _2 int, product double")
        assert sorted(tuple(r) for r in ridge_solve(a, c).collect()) == [(0, 0, 1.0), (0, 1, 2.0)]
        print("OK")
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), env=env,
                       capture_output=True, text=True, timeout=600)
    assert r.returncode == 0 and "OK" in r.stdout, r.stderr[-3000:]
