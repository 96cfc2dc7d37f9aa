"""polylogue: Spark-native preparation and evaluation of multilingual dialogue corpora.

Operators are DataFrame functions: few-shot sampling and ratio interleave of
per-language corpora, prompt templating and token-id tables, prediction
cleaning, distinct-n and BLEU metrics per language and system, and blinded A/B
ballots with their tallies.
"""

__version__ = "0.1.0"
