"""The same results from data that arrive bit by bit."""
