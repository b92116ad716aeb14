"""Readers and writers: text folders, lexicons, company tables, the token index, page captures, exports, the score cache."""
