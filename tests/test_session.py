from types import SimpleNamespace

import pytest

from loomspark import session


def test_a_cluster_needs_a_shared_folder():
    def fake(master, named=None):
        conf = SimpleNamespace(get=lambda k, d=None: named)
        sc = SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(sparkContext=sc, conf=conf)

    with pytest.raises(ValueError):
        session.shared_dir(fake("spark://host:7077"))
    with pytest.raises(ValueError):
        session.shared_dir(fake("local-cluster[2,1,1024]"))
    assert session.shared_dir(fake("spark://host:7077", "/shared")) == "/shared"
    assert session.shared_dir(fake("local[2]"))
