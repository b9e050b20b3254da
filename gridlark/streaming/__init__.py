"""gridlark.streaming"""
