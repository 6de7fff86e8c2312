"""Where tables between jobs are written: in the shared folder, and never in a local one on a cluster."""

from types import SimpleNamespace

import pytest

from farsight.sources import shared


def _session(master, folder=None, checkpoints=None):
    said = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoints, setCheckpointDir=said.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=context), said


@pytest.mark.parametrize("master", ["local", "local[4]", "local-cluster[2,1,1024]", "spark://host:7077", "yarn"])
def test_the_setting_comes_first(master):
    session, said = _session(master, "hdfs://shared/folder/")
    assert shared.shared_base(session) == "hdfs://shared/folder" and said == []


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://https://host"])
def test_a_cluster_needs_the_setting(master):
    session, said = _session(master)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_base(session)
    assert said == []


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4,2]"])
def test_one_process_may_use_a_local_folder(master):
    session, said = _session(master)
    assert shared.shared_base(session) == shared.LOCAL and said == [shared.LOCAL]
    session, said = _session(master, checkpoints="file:/else")
    assert shared.shared_base(session) == shared.LOCAL and said == []
