from types import SimpleNamespace

import pytest

from tideline.session import shared_dir, ship_package


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    settings = {}
    fake = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: settings.get(key, default)),
        sparkContext=SimpleNamespace(master=master),
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake, "x")
    settings["spark.checkpoint.dir"] = "/shared/"
    assert shared_dir(fake, "x").startswith("/shared/x-")


def test_the_package_is_shipped_once(spark):
    for _ in range(2):
        ship_package(spark)
    assert sum(name.endswith("/tideline.zip") for name in spark.sparkContext.listFiles) == 1
