"""Folders for written tables."""

from types import SimpleNamespace

import pytest

from corpusloom.operators.storage import shared_folder


def session(master, found=None, conf=None):
    """As much of a session as the folder asks for."""
    made = []
    holder = SimpleNamespace(isDefined=lambda: found is not None, get=lambda: found)
    context = SimpleNamespace(master=master, setCheckpointDir=made.append, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: holder)))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: conf), sparkContext=context), made


def test_the_session_names_the_folder():
    assert shared_folder(session("spark://a:7077", conf="hdfs://x/y/")[0], "k").startswith("hdfs://x/y/k-")
    assert shared_folder(session("spark://a:7077", found="hdfs://z")[0]).startswith("hdfs://z/t-")


def test_a_cluster_without_a_folder_is_an_error():
    with pytest.raises(ValueError, match="share"):
        shared_folder(session("spark://a:7077")[0])


def test_one_machine_gets_its_own():
    spark, made = session("local[4]")
    assert shared_folder(spark).startswith(made[0])
