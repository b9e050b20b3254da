"""gridlark.functions"""
