"""Lexicon, matching, overlap resolution, scores, companies, concordance and sparse exports."""
