"""Fixed values of the model."""

# Reserved token for "aligned to nothing": ids start at 1, so 0 is free.
NULL_ID = 0
NULL_WORD = "<null>"

# Prior of the NULL word, prior of all real words, EM rounds.
NULL_PRIOR = 0.20
WORD_PRIOR = 0.80
EM_ROUNDS = 20

# Extensions of a pair of parallel files.
SRC_EXT = "en"
TGT_EXT = "fr"
