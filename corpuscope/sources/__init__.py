"""Reading and writing corpora, thesauri and term lists."""
