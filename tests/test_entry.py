import __spark_entry__ as e


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_import_needs_no_session():
    import subprocess
    import sys

    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(), e.oracle_sql()"], cwd=e.Path(e.__file__).parent).returncode == 0


def test_checkpoint_names(spark, rows):
    assert rows(e.queries()["q_latest_checkpoint"](spark, "")) == [(10, 1)]
