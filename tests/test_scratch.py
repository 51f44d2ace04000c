from __future__ import annotations

import pytest

from trailmill import scratch


def test_written_tables_are_read_again_and_dropped(spark):
    d = scratch.materialise(spark.range(5), "five")
    assert d.count() == 5 and scratch.scratch_root(spark) in d.inputFiles()[0]


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://somewhere"
        applicationId = "x"

        class _jsc:
            @staticmethod
            def sc():
                class Inner:
                    @staticmethod
                    def getCheckpointDir():
                        class Empty:
                            @staticmethod
                            def isEmpty():
                                return True

                        return Empty

                return Inner

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        scratch.scratch_root(Session)
