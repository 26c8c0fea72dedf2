import pytest


@pytest.fixture(scope="session")
def sf(request):
    return "/root/testdata/sf0.001"
