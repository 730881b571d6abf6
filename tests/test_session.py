import pytest

from rowmill import session


class Context:
    applicationId = "app-1"

    def __init__(self, master, base=None):
        self.master, self.base = master, base

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.base if key == "spark.checkpoint.dir" and self.base else default


class Session:
    def __init__(self, master, base=None):
        self.sparkContext = self.conf = Context(master, base)


def test_the_cluster_names_the_folder():
    assert session.shared_base(Session("yarn", "hdfs:///shared/")) == "hdfs:///shared"


@pytest.mark.parametrize("master", ["yarn", "local[2]"])
def test_a_session_without_a_folder_is_refused(master):
    with pytest.raises(RuntimeError):
        session.shared_base(Session(master))


def test_scratch_paths_are_fresh():
    one = Session("local[2]", "/shared")
    paths = {session.scratch_dir(one, "x") for _ in range(3)}
    assert len(paths) == 3 and all(p.startswith("/shared/") for p in paths)
