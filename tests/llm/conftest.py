import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def words_path():
    return str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="session")
def bytes_path():
    return str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture()
def shared(spark):
    from refrain.llm.common import fresh_dir

    return lambda tag: fresh_dir(spark, tag)
