"""gridlark.plans"""
