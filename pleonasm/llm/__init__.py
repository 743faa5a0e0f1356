"""Operators for preparing training text out of prompts and conversations.

Each works on rows of `prompts(prompt_id, text)` or of chat messages, and nothing outside this folder imports them.
"""
