"""Operations for large training corpora."""
