import pytest


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_schema():
    """documents with extra columns whose names the operators use inside."""
    return "doc_id long, text string, lang string, found string, blob string"
