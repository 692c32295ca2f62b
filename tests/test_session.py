import pytest

from pagesift.session import LOCAL


@pytest.mark.parametrize("master, local", [("local", True), ("local[4]", True), ("local[*]", True), ("local[2,3]", True),
                                           ("local-cluster[2,1,1024]", False), ("spark://h:7077", False), ("yarn", False)])
def test_only_one_process_may_use_a_scratch_folder(master, local):
    assert bool(LOCAL.fullmatch(master)) == local
