from cuelens.lexicon.corpus import CORPUS
from cuelens.lexicon.mandarin import MANDARIN

__all__ = ["CORPUS", "MANDARIN"]
