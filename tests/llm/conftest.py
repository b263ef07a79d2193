import pytest

TOKENIZER, RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


@pytest.fixture(scope="session")
def vocab():
    import public_tokenizers

    return public_tokenizers.path
