import os

from attestra.functions.tables import forget, keep, run_dir


def test_tables_of_a_session_are_forgotten(spark):
    """A session's own folder goes, that of another stays; what is kept later has a new one."""
    kept, session = keep(spark.range(3), "numbers"), spark.newSession()
    assert keep(session.range(2), "numbers").count() == 2
    own = run_dir(session).removeprefix("file://")
    assert os.listdir(own)
    forget(session)
    assert not os.path.exists(own) and run_dir(session).removeprefix("file://") != own and kept.count() == 3
