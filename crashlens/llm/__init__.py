"""Operators for preparing training text at scale; self-contained (nothing else imports this package).

===  ==========================  =====================================================
 no  module                      operator
===  ==========================  =====================================================
  1  ``html_blocks``             page main text by a recurrent block labeller
  2  ``cross_polytope``          approximate nearest neighbours by cross-polytope hashing
  3  ``mixing``                  source mixing by hash-threshold histograms (native)
  4  ``quality_ledger``          quality rules as a failure bitmask ledger
  5  ``substring_cover``         substring de-duplication by difference-cover anchors
  6  ``toxicity_chain``          toxicity by a classifier chain
  7  ``unigram_count``           token counts by count-only Viterbi
  8  ``packing``                 bounded-space best-fit packing
  9  ``fast_minhash``            near-duplicates by fast similarity sketching
 10  ``warc``                    WARC archives and revisit resolution
 11  ``quotient_filter``         exact de-duplication with counting quotient filters
 12  ``merkle_manifest``         Merkle manifest with leaf places from bitmap ranks
 13  ``target_resampling``       importance resampling with a distributed radix sort
===  ==========================  =====================================================

``words``, ``frames``, ``salted`` and ``store`` are shared helpers, ``queries`` and ``oracle`` register the queries.
"""
