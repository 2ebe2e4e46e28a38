"""Ids of whole documents from the tokenizers library, asked once for every distinct pretoken of a batch."""

from __future__ import annotations

from itertools import chain

import numpy as np

from earmark.llm.pretokens import BatchEncoder


class LibraryEncoder(BatchEncoder):
    """``Tokenizer.from_file(path)`` over pretokens; texts outside the fast split go to it as they are."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        super().__init__(self.words, self.text, specials)

    def words(self, words: list[str]):
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def text(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False).ids
