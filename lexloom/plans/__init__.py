"""Whole answers: operators put together the way a user asks for them."""
