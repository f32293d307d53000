"""Training-data operators: licence scan, dedup, toxicity, mixing, chat
formatting, language ID, decontamination and HTML extraction.

Nothing outside this subpackage imports it.
"""
