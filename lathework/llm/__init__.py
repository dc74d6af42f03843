"""Operations for building training corpora: each module is one operator."""
