from types import SimpleNamespace

import pytest

from millrace import session


def fake(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4,2]"])
def test_a_temporary_folder_in_local_mode(master, monkeypatch):
    monkeypatch.setattr(session.tempfile, "mkdtemp", lambda prefix: f"/somewhere/{prefix}")
    assert session.shared_folder(fake(master)) == "/somewhere/shared"


@pytest.mark.parametrize("master", ["local-cluster[3,2,1024]", "spark://host:7077", "yarn"])
def test_a_cluster_names_its_folder(master):
    assert session.shared_folder(fake(master, "s3a://bucket/ckpt")) == "s3a://bucket/ckpt"
    with pytest.raises(RuntimeError):
        session.shared_folder(fake(master))
