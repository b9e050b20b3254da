"""gridlark.operators"""
